"""Trained operators: languages, scores, quality, toxicity. Held-out accuracy and defined odd cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import common, langid, pseudo_lm, quality, toxicity
from quarry.llm.common import fold, labelled_sample, sample_table
from quarry.llm.features import Characters, Texts, sums

from .conftest import ODD, prose

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


def test_folds(spark):
    got = spark.createDataFrame([(i,) for i in (0, 1, 17, 99999, None)], "doc_id long").select("doc_id", fold(F.col("doc_id"), 4).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["doc_id"]).encode() if r["doc_id"] is not None else b"") % 4 for r in got)


def test_samples_are_bounded_and_stable(docs_of, spark):
    d = docs_of([(i, f"text {i}") for i in range(50)] + [(1, "another")])
    known = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, None), (2, 1), (2, 0)], "doc_id long, label int")
    a = labelled_sample(d, known, F.col("doc_id") != 5, 8, 1)
    assert a == labelled_sample(d.repartition(7), known.repartition(5), F.col("doc_id") != 5, 8, 1)
    assert sorted(y for _, y in a) == [0] * 8 + [1] * 8 and "text 5" not in {t for t, _ in a}


def test_one_task_trains_on_the_whole_sample_in_order(docs_of, spark):
    d = docs_of([(i, f"text {i}") for i in range(50)] + [(1, "another"), (None, "no id")], label="w", draw="x")
    known = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, label int")
    told = labelled_sample(d, known, F.lit(True), 8, 1)
    for n in (1, 2, 7):
        assert common.trained(sample_table(d.repartition(n), known.repartition(n), F.lit(True), 8, 1), list) == told
    assert len(told) == 16 and {type(y) for _, y in told} == {int}
    assert common.trained(sample_table(d, known.where("label > 1"), F.lit(True), 8, 1), list) == []
    assert common.trained(sample_table(d.limit(0), known, F.lit(True), 8, 1), list) == []


def test_samples_keep_long_texts_and_every_label(docs_of, spark, monkeypatch):
    d = docs_of([(i, "x" * 200_000 if i % 2 else f"t{i}") for i in range(40)])
    known = spark.createDataFrame([(i, f"l{i // 2:04d}") for i in range(40)], "doc_id long, label string")
    every = labelled_sample(d, known, F.lit(True), 5, 1)
    assert len(every) == 40 and sum(len(t) == 200_000 for t, _ in every) == 20
    monkeypatch.setattr(common, "SAMPLE_ROWS", 25)
    assert len({y for _, y in labelled_sample(d, known, F.lit(True), 5, 1)}) == 20 == len(labelled_sample(d, known, F.lit(True), 5, 1))
    monkeypatch.setattr(common, "SAMPLE_ROWS", 10)
    with pytest.raises(ValueError, match="label values"):
        labelled_sample(d, known, F.lit(True), 5, 1)


def test_words_and_grams_do_not_depend_on_neighbours():
    texts = ["one two", "", "three  four\n", "é", "x" * 300]
    together = Texts([t.encode() for t in texts])
    hashes = together.words()
    for i, t in enumerate(texts):
        own = Texts([t.encode()]).words()
        assert (hashes[together.word_from[i] : together.word_from[i + 1]] == own).all()
        assert len(own) == len(t.split())
        for n in (1, 2, 3, 4):
            alone = Texts([t.encode()])
            assert (together.grams(n)[together.starts[i] : together.ends[i]] == alone.grams(n)[: alone.ends[0]]).all()


def test_characters_are_whole():
    texts = ["naïve", "", "日本語x", "😀a"]
    together = Characters([t.encode() for t in texts])
    for i, t in enumerate(texts):
        alone = Characters([t.encode()])
        assert alone.ends[0] == len(t) + 1
        for n in (1, 3, 4):
            assert (together.grams(n)[together.starts[i] : together.ends[i]] == alone.grams(n)[: alone.ends[0]]).all()


def plain_word(word):
    """The hash of a word's bytes, one by one."""
    code = sum((b + 1) * pow(0x100000001B3, i, 1 << 64) for i, b in enumerate(word)) * 0x9E3779B97F4A7C15 % (1 << 64)
    return code ^ code >> 29


def plain_gram(units, n, base):
    code = 0
    for u in units:
        code = code * base + u
    code = (code + n * 0x100000001B3) * 0x9E3779B97F4A7C15 % (1 << 64)
    return code ^ code >> 29


def test_sums_of_ranges_with_gaps():
    v = np.arange(20.0)
    assert sums(v, np.array([0, 3, 5, 9]), np.array([2, 3, 8, 20])).tolist() == [1.0, 0.0, 18.0, sum(range(9, 20))]


# -- languages ------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9, 40])
def test_codewords_are_far_apart(n):
    code = langid.codewords(n)
    apart = min((code[a] != code[b]).sum() for a in range(n) for b in range(a))
    assert code.shape[0] == n and apart >= (1 if n == 2 else code.shape[1] // 4)
    assert len({tuple(c) for c in code.T}) == code.shape[1] or n > langid.EXHAUSTIVE


def test_language_held_out(documents):
    found = langid.language(documents).join(documents.select("doc_id", "lang"), "doc_id").toPandas()
    held = found[found["held_out"]]
    assert len(found) == 1000 and len(held) > 200
    assert (held["lang_pred"] == held["lang"]).mean() > 0.98 and found["score"].between(0, 1).all()


def test_one_wrong_bit_is_corrected():
    code = langid.codewords(5)
    model = langid.Model(list("abcde"), code, np.zeros((1, code.shape[1])), np.zeros(code.shape[1]))
    for row in range(5):
        for bit in range(code.shape[1]):
            margins = 3 * code[row].copy()
            margins[bit] *= -1
            assert model.decode(margins[None])[0][0] == row
    assert model.decode(np.zeros((1, code.shape[1])))[2][0]


def test_language_odd(odd, docs_of):
    got = {(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.language(odd).collect()}
    assert {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (4, "en", 1.0), (8, "en", 1.0)} <= got
    assert langid.language(docs_of([])).count() == 0
    assert {r["lang_pred"] for r in langid.language(docs_of([(1, "abc")]).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_equals_plain_scorer(docs_of):
    """Gram by gram, bit by bit, codeword by codeword."""
    sample = [(prose(i, 40), "en") for i in range(20)] + [(" ".join(w[::-1] for w in prose(i, 40).split()), "rev") for i in range(20)] + [("ñandú École " * 9, "es")] * 5
    model = langid.train(sample)
    texts = [t or "" for _, t in ODD] + ["Éa", prose(5, 3)]
    for text, (_, got) in zip(texts, model.predict(texts).iterrows(), strict=True):
        if not any(c.isalpha() for c in text):
            assert got["lang_pred"] == "und"
            continue
        raw = (" " + " ".join(text.lower().split())).encode() + b" "
        margin = np.zeros(model.code.shape[1])
        for n in langid.GRAMS:
            padded = raw + b" " * (n - 1)
            for at in range(len(raw)):
                margin += model.weight[plain_gram(padded[at : at + n], n, 256) % langid.BUCKETS]
        margin = margin / (len(langid.GRAMS) * len(raw)) + model.bias
        loss = [sum(np.log1p(np.exp(-m * b)) for m, b in zip(margin, row, strict=True)) for row in model.code]
        assert got["lang_pred"] == model.names[int(np.argmin(loss))]
        assert got["score"] == pytest.approx(1 / sum(np.exp(min(loss) - x) for x in loss), rel=1e-4)


# -- quality --------------------------------------------------------------------------------


def plain_quality(model, text):
    """Feature by feature."""
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).encode().split(b" ") if w]
    letters = [ord(c) for c in text + " "]
    found = [plain_word(w) % (quality.BUCKETS - 1) + 1 for w in words]
    found += [quality.REPEAT for a, b in zip(words, words[1:], strict=False) if a == b]
    for n in quality.GRAMS:
        padded = letters + [32] * n
        found += [plain_gram(padded[at : at + n], n, 0x100000001B3) % (quality.BUCKETS - 1) + 1 for at in range(len(letters))]
    return 1 / (1 + np.exp(-(sum(float(model.weight[b]) for b in found) / len(found) + model.bias)))


def test_quality_equals_plain_scorer():
    model = quality.train([(prose(i, 40), 1) for i in range(20)] + [("junk junk ñ日 " * 9 + prose(i, 4), 0) for i in range(20)])
    for text in [t or "" for _, t in ODD] + ["Éa éa 日本語", "a a a"]:
        assert model.score([text.encode()])[0] == pytest.approx(plain_quality(model, text), rel=1e-4)


def test_quality_held_out(documents, labels):
    found = quality.quality(documents, labels).join(labels, "doc_id").toPandas()
    held = found[found["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.93 and found["score"].between(0, 1).all()


@pytest.mark.parametrize("op,column", [(quality.quality, "quality"), (toxicity.toxicity, "toxic")])
def test_scores_odd(spark, odd, docs_of, op, column):
    none = spark.createDataFrame([], f"doc_id long, {column} int")
    got = op(odd, none)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and {r["score"] for r in got.collect()} == {0.5}
    known = spark.createDataFrame([(i, i % 2) for i in range(1, 10)] + [(None, 1), (4, None), (5, 7)], f"doc_id long, {column} int")
    rows = op(odd, known).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (5, 6)}) == 1
    assert op(docs_of([]), known).count() == 0


def test_filters_keep_all_columns(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for keep in (quality.keep_good, toxicity.keep_civil):
        kept = keep(odd, none)
        assert kept.columns == odd.columns and kept.count() == len(ODD)


# -- toxicity -------------------------------------------------------------------------------


def test_gradients():
    lex = toxicity.Lexicon([b"you are an awful and a mean one", b"nice words about gardens", b"x"])
    net = toxicity.Network()
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    rows, _ = lex.windows()
    y = np.array([1.0, 0.0, 1.0])
    old, toxicity.f32 = toxicity.f32, np.float64
    try:
        _, dense, tables = net.gradients(lex, rows, y)
        word, gram = tables["word"], tables["gram"]
        points = [("xf", (3, 5)), ("hf", (2, 10)), ("hb", (1, 20)), ("xb", (12, 0)), ("cf", (7,)), ("attend", (3,)), ("out", (9,)), ("bias", (0,))]
        cases = [(k, i, dense[k][i]) for k, i in points] + [("word", (word[0][2], 3), word[1][2, 3]), ("gram", (gram[0][4], 1), gram[1][4, 1])]
        for k, i, slope in cases:
            at = net.p[k][i]
            losses = []
            for step in (1e-5, -1e-5):
                net.p[k][i] = at + step
                losses.append(net.gradients(lex, rows, y)[0])
            net.p[k][i] = at
            assert slope == pytest.approx((losses[0] - losses[1]) / 2e-5, rel=1e-3, abs=1e-8)
    finally:
        toxicity.f32 = old


def plain_toxicity(net, text):
    """Window by window, state by state."""
    p = {k: v.astype(float) for k, v in net.p.items()}
    H = toxicity.HIDDEN

    def vector(word):
        padded, grams = word + b"\0\0", []
        for at in range(len(word)):
            code = 0
            for b in padded[at : at + 3]:
                code = code << 8 | b
            code = (code + (at == 0) * 0x100000001B3) * 0x9E3779B97F4A7C15 % (1 << 64)
            grams.append(p["gram"][(code ^ code >> 29) % toxicity.GRAMS])
        return np.concatenate([p["word"][plain_word(word) % toxicity.WORDS], np.mean(grams, axis=0)])

    def states(xs, side):
        h, out = np.zeros(H), []
        for x in xs:
            g, v = x @ p[f"x{side}"] + p[f"c{side}"], h @ p[f"h{side}"]
            z, r = (1 / (1 + np.exp(-(g[i * H : i * H + H] + v[i * H : i * H + H]))) for i in (0, 1))
            h = z * h + (1 - z) * np.tanh(g[2 * H :] + r * v[2 * H :])
            out.append(h)
        return out

    raw = text.encode().translate(bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)))
    words = [vector(w) for w in raw.split(b" ") if w]
    if net.prior is not None:
        return net.prior
    if not words:
        return 1 / (1 + np.exp(-p["bias"][0]))
    last = max(0, len(words) - toxicity.WINDOW)
    best = 0.0
    for start in [*range(0, last, toxicity.STEP), last]:
        xs = words[start : start + toxicity.WINDOW]
        both = [np.concatenate(s) for s in zip(states(xs, "f"), states(xs[::-1], "b")[::-1], strict=True)]
        e = np.exp([s @ p["attend"] for s in both])
        pooled = sum(a * s for a, s in zip(e / e.sum(), both, strict=True))
        best = max(best, 1 / (1 + np.exp(-(pooled @ p["out"] + p["bias"][0]))))
    return best


def test_toxicity_equals_plain_scorer():
    net = toxicity.train([(prose(i, 50) + (" awful fool " if i % 2 else ""), i % 2) for i in range(30)])
    for text in (prose(1, 5), prose(2, 33) + " awful fool", prose(3, 100), "É Ça va", "", " -- "):
        assert net.score([text.encode()])[0] == pytest.approx(plain_toxicity(net, text), rel=1e-3)


def test_windows_cover_and_overlap():
    for n in (0, 1, 31, 32, 33, 56, 57, 500):
        lex = toxicity.Lexicon([" ".join(f"w{i}" for i in range(n)).encode()])
        rows, text = lex.windows()
        seen = [[lex.number.tolist().index(w) for w in r if w >= 0] for r in rows.tolist()]
        assert sorted({i for s in seen for i in s}) == list(range(n)) and len(text) == (0 if n == 0 else 1 + max(0, -(-(n - 32) // 24)))
        assert all(set(a) & set(b) for a, b in zip(seen, seen[1:], strict=False))


def test_planted_insults(docs_of, spark):
    insult = ["vilebeast", "rottenfool", "slimecreature"]

    def text(i):
        words = prose(i, 80).split()
        if i % 3 == 0:
            words[(7 * i) % 80 : (7 * i) % 80] = [insult[i % 9 // 3], "you"]
        return " ".join(words)

    docs = docs_of([(i, text(i)) for i in range(600)] + [(999, prose(3, 9000) + " you " + insult[1] + " " + prose(4, 9000)), (998, prose(5, 18000))])
    known = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)], "doc_id long, toxic int")
    found = toxicity.toxicity(docs, known).toPandas().set_index("doc_id")
    held = found[found["held_out"] & (found.index < 900)]
    assert (held["predicted"] == (held.index % 3 == 0)).mean() > 0.97
    assert found.loc[999, "predicted"] == 1 and found.loc[998, "predicted"] == 0


# -- pseudo-likelihood ----------------------------------------------------------------------


def test_scores_sum_up_and_context_helps(docs_of):
    cycle = "red green blue white black grey".split()
    rows = [(i, " ".join(cycle[(i + j) % 6] for j in range(300))) for i in range(60)]
    mixed = [(100 + i, " ".join(np.random.default_rng(i).choice(cycle, 300))) for i in range(5)]
    docs = docs_of(rows + mixed)
    got = {r["doc_id"]: r for r in pseudo_lm.score_documents(docs).collect()}
    ordered, shuffled = (np.mean([got[i]["mean_log_prob"] for i in ids]) for ids in (range(60), range(100, 105)))
    assert ordered > np.log(1 / 6) + 0.5 and ordered > shuffled + 0.5
    assert all(r["log_prob"] == pytest.approx(r["mean_log_prob"] * r["n_tokens"]) and r["n_tokens"] == 300 for r in got.values())


def trained(docs):
    """Counts, what stands for all words, and the network, as ``score_documents`` makes them."""
    found = pseudo_lm.learnt(docs)
    counts = found.where("word is not null").groupBy("word").agg(F.sum("n").alias("n"))
    net = pseudo_lm.averaged(found.where("piece is not null").select("shard", "tokens", "piece", "values"))
    return {r["word"]: r["n"] for r in counts.collect()}, pseudo_lm.Corpus.of(counts), net


def test_counts_are_whole(odd):
    from collections import Counter

    want = Counter()
    for _, t in ODD:
        want.update(pseudo_lm.tokens([(t or "").encode()])[1].tolist())
    assert trained(odd)[0] == dict(want)


def test_word_probabilities_sum_to_one(docs_of):
    """Where all words stand for themselves; else nearly so."""
    few = docs_of([(i, prose(i, 90)) for i in range(40)])
    many = docs_of([(i, prose(i, 60) + " " + " ".join(f"w{j}x" for j in range(i, i + 60))) for i in range(60)])
    for docs, bound in ((few, 1e-4), (many, 0.05)):
        counts, corpus, net = trained(docs)
        words = np.array(list(counts))
        text = pseudo_lm.tokens([prose(3, 9).encode()])
        for at in range(9):
            around = np.repeat(pseudo_lm.contexts(*text)[:, at : at + 1], len(words), axis=1)
            fits = net.fit(around, pseudo_lm.outs(words), corpus.some, corpus.weight)
            assert (np.exp(fits) * np.array(list(counts.values()))).sum() / corpus.total == pytest.approx(1, abs=bound)


def test_pseudo_likelihood_gradients():
    net = pseudo_lm.Network({k: v.astype(float) for k, v in pseudo_lm.Network.fresh().p.items()})
    t, words = pseudo_lm.tokens([b"one two three four", b"two one"])
    around, out, noise = pseudo_lm.contexts(t, words), pseudo_lm.outs(words), pseudo_lm.outs(words)[[0, 3, 3]]

    def loss():
        h = net.hidden(around)
        return (np.log(np.exp(h @ net.p["out"][noise].T).sum(axis=1)) - (h * net.p["out"][out]).sum(axis=1)).sum()

    back, d_own, d_noise = net.gradients(around, out, noise)
    inputs = {(int(at), 4): sum(back[j, 4] for i in range(len(around)) for j in range(len(out)) if around[i, j] == at) for at in (around[2, 1], around[0, 0])}
    outputs = {(int(o), 7): sum(d_own[j, 7] for j in range(len(out)) if out[j] == o) + sum(d_noise[j, 7] for j in range(3) if noise[j] == o) for o in set(out.tolist())}
    for name, slopes in (("context", inputs), ("out", outputs), ("inner", {(4,): back.sum(axis=0)[4]})):
        for at, slope in slopes.items():
            held = net.p[name][at]
            losses = []
            for step in (1e-5, -1e-5):
                net.p[name][at] = held + step
                losses.append(loss())
            net.p[name][at] = held
            assert slope == pytest.approx((losses[0] - losses[1]) / 2e-5, rel=1e-4, abs=1e-8)


def test_pseudo_likelihood_odd(odd, docs_of):
    got = [tuple(r) for r in pseudo_lm.score_documents(odd).collect()]
    assert len(got) == len(ODD) and {(1, 0, 0.0, None), (2, 0, 0.0, None), (3, 0, 0.0, None)} <= set(got)
    assert pseudo_lm.score_documents(docs_of([])).count() == 0


RARE = [(i, prose(i, 40) + " " + " ".join(f"w{j}x" for j in range(60 * (i % 4), 60 * (i % 4) + 200))) for i in range(12)] + [(20, "only here w3x w3x"), (21, "")]


def test_scores_equal_plain_ones(docs_of, monkeypatch):
    """Token by token, each word by its own count, however rare; in blocks and shards of any size."""
    docs = docs_of(RARE)
    for block, shard in ((1_000_000, 1_000_000), (1, 3000)):
        monkeypatch.setattr(pseudo_lm, "BLOCK", block)
        monkeypatch.setattr(pseudo_lm, "SHARD", shard)
        monkeypatch.setattr(pseudo_lm, "TOGETHER", 2)
        counts, corpus, net = trained(docs)
        p = {k: v.astype(float) for k, v in net.p.items()}
        want = {}
        for i, text in RARE:
            _, words = pseudo_lm.tokens([text.encode()])
            total = 0.0
            for at, word in enumerate(words.tolist()):
                hidden = p["inner"].copy()
                for n, place in enumerate(pseudo_lm.PLACES):
                    inside = 0 <= at + place < len(words)
                    own = words[at + place] >> 40 & pseudo_lm.INS - 2 if inside else pseudo_lm.INS - 1
                    hidden += p["context"][n * pseudo_lm.INS + own]
                h = np.tanh(hidden)
                every = sum(w * np.exp(h @ p["out"][s]) for s, w in zip(corpus.some, corpus.weight, strict=True))
                total += np.log(counts[word] / sum(counts.values())) + h @ p["out"][word >> 20 & pseudo_lm.OUTS - 1] - np.log(every)
            want[i] = total
        assert len(counts) > 250 and len(set(counts.values())) > 5
        got = {r["doc_id"]: r["log_prob"] for r in pseudo_lm.score_documents(docs).collect()}
        assert got == pytest.approx(want, rel=1e-4)


def test_scores_do_not_depend_on_partitions(docs_of, monkeypatch):
    monkeypatch.setattr(pseudo_lm, "SHARD", 4000)
    docs = docs_of([*RARE, *ODD])
    a, b = (sorted((repr(r["doc_id"]), r["log_prob"]) for r in pseudo_lm.score_documents(docs.repartition(n)).collect()) for n in (2, 7))
    assert [x[0] for x in a] == [x[0] for x in b] and [x[1] for x in a] == pytest.approx([x[1] for x in b], rel=1e-9)


def test_every_token_is_learnt_from(docs_of):
    """Also of a text that repeats in all rows, and of all shards."""
    docs = docs_of([(i, prose(0, 12)) for i in range(1500)])
    rows = pseudo_lm.learnt(docs).where("piece = 0").select("tokens").collect()
    assert sum(r["tokens"] for r in rows) == 1500 * 12
    _, corpus, net = trained(docs)
    text = pseudo_lm.tokens([prose(0, 12).encode()])
    fresh, own = (n.fit(pseudo_lm.contexts(*text), pseudo_lm.outs(text[1]), corpus.some, corpus.weight).mean() for n in (pseudo_lm.Network.fresh(), net))
    assert own > fresh + 1
