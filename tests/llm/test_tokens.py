"""Operators on tokens and vectors: counts, packing, nearest neighbours."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import bpe_count, packing, pretokens, vptree

from .conftest import ODD, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(PATH)


def strange(n, seed=1):
    draw = random.Random(seed)
    letters = "abz '’ \u0085\x1c\x1d\n\t  éßñ²½٣中文😀 ǅ<|endoftext|>'s'll'RE%_\x0b\x00​　"
    return ["".join(draw.choice(letters) for _ in range(draw.randint(0, 60))) + draw.choice(["", "<|endoftext|>", " x"]) for _ in range(n)]


def test_counts_equal_the_library(model):
    vocab = pretokens.vocabulary(PATH)
    texts = strange(1500) + [prose(3, 300), "a" * 3000, " " * 700, "x" * 65 + " " + "x" * 65]
    assert [bpe_count.count_tokens(t, vocab) for t in texts] == [len(e.ids) for e in model.encode_batch(texts, add_special_tokens=False)]


def test_merges_give_the_library_symbols(model):
    vocab = pretokens.vocabulary(PATH)
    for piece in {p for t in strange(300, 2) + [prose(5, 200)] for _, part in vocab.spans(t) for p in pretokens.pieces(part)} - set(vocab.special):
        ids, merged = vocab.merge(piece.encode())
        assert [i for i in ids if i >= 0] == model.encode(piece, add_special_tokens=False).ids and merged == len(piece.encode()) - sum(i >= 0 for i in ids)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        pretokens.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_count_odd(odd, docs_of, model):
    got = sorted(repr(tuple(r)) for r in bpe_count.count_documents(odd, PATH).collect())
    sizes = [(i, len((t or "").encode()), len(model.encode(t or "", add_special_tokens=False).ids)) for i, t in ODD]
    assert got == sorted(repr((i, b, n, n > 512)) for i, b, n in sizes)
    assert bpe_count.count_documents(docs_of([]), PATH).count() == 0


# -- packing --------------------------------------------------------------------------------


def check_packing(rows, pieces, model, size):
    """Every id in one piece, sequences gapless and not too long; gives the share of padding."""
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert set(by_doc) == set(texts)
    for i, own in by_doc.items():
        copies = len(texts[i])
        ids = texts[i][0]
        assert all((t == ids).all() for t in texts[i])
        for start in {p["start"] for p in own}:
            same = [p for p in own if p["start"] == start]
            assert len(same) == copies and len({p["length"] for p in same}) == 1
        spans = sorted({(p["start"], p["length"]) for p in own})
        assert [a for a, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1]] and sum(n for _, n in spans) == len(ids)
        for p in own:
            assert p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
    total = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= size and {p["sequence_tokens"] for p in own} == {at}
        total += at
    return 1 - total / (size * len(by_sequence))


@pytest.mark.parametrize("most", [2, 256])
def test_packing_round_trip(docs_of, model, most):
    rows = [r for r in ODD if r[0] is not None] + [(50 + i, prose(i, 5 + 13 * i % 400)) for i in range(150)] + [(300, strange(1)[0] + "<|endoftext|>")]
    padding = check_packing(rows, packing.pack(docs_of(rows, part="p", open="o"), PATH, 128, most).collect(), model, 128)
    assert padding < (0.1 if most == 2 else 0.03)


def test_packing_keeps_null_ids_apart(odd, docs_of):
    got = packing.pack(odd, PATH).collect()
    assert [r["doc_tokens"] for r in got if r["doc_id"] is None] == [6]
    assert packing.pack(docs_of([]), PATH).count() == 0
    big = packing.pack(docs_of([((1 << 60) + 1, "x"), (None, "y")]), PATH).collect()
    assert {r["doc_id"] for r in big} == {(1 << 60) + 1, None}


def test_windows_rules():
    w = packing.Windows(10, 2)
    assert w.place(6, "a") == [] and w.place(7, "b") == []
    assert w.place(3, "c") == [[(0, 7, "b"), (7, 3, "c")]]  # the best fit, and full
    assert w.place(5, "d") == [] and w.place(6, "e") == [[(0, 6, "a")]]  # none fits: the fullest goes
    assert sorted(x[2] for own in w.rest() for x in own) == ["d", "e"]


def test_both_encoders_give_the_library_ids(model):
    """Strange texts, and runs that nothing cuts: the faster encoder, and from LONG_RUN on the library itself."""
    code = packing.Encoder(PATH)
    for text in [*strange(3000, 7), "a" * 999, "a" * 1000, "ab" * 2000, " " * 999 + "x", " " * 3000, "日" * 1200, "x " * 4000 + "é" * 1001]:
        assert np.frombuffer(code.encode(text), "<u4").tolist() == [*model.encode(text, add_special_tokens=False).ids, 0]


# -- nearest neighbours ---------------------------------------------------------------------


def plain_nearest(rows, k, step):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = []
    for q in np.flatnonzero(ids % step == 0):
        far = np.sqrt(((x[q] - x) ** 2).sum(axis=1))
        far[ids == ids[q]] = np.inf
        order = [i for i in np.lexsort((ids, far)) if np.isfinite(far[i])][:k]
        out += [(int(ids[q]), n, int(ids[i]), float(far[i])) for n, i in enumerate(order, 1)]
    return out


@pytest.fixture(scope="module")
def vectors():
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=8).astype(np.float32).tolist()) for i in range(700)]
    return [(i, rows[7][1] if i % 3 == 0 else v) for i, v in rows]  # a third are one vector


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, shard string").repartition(3)


def test_factor_one_is_exact(spark, vectors, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD", 150)
    monkeypatch.setattr(vptree, "BLOCK", 10)
    got = sorted(tuple(r) for r in vptree.nearest(table(spark, vectors), F.col("vec_id") % 20 == 0, factor=1.0).collect())
    want = plain_nearest(vectors, 10, 20)
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)


def test_regions_bound_distances():
    draw = np.random.default_rng(2)
    x, q = draw.normal(size=(600, 6)), draw.normal(size=(40, 6))
    regions = vptree.Regions(x[:300], 16)
    own, bounds = regions.of(x), regions.bounds(q)
    far = vptree.distances(q, x)
    assert regions.count == 16 and set(own.tolist()) == set(range(16))
    assert all((far[:, own == r].min(axis=1) >= bounds[:, r] - 1e-12).all() for r in range(16)) and (bounds > 0).any()
    assert vptree.Regions(np.ones((50, 3)), 8).count == 1


@pytest.mark.parametrize("kind", ["clusters", "low rank", "round"])
def test_recall_with_a_fitted_factor(spark, monkeypatch, kind):
    """Over several regions, parts and blocks; where vectors are not equidistant, trees save work."""
    monkeypatch.setattr(vptree, "SHARD", 400)
    monkeypatch.setattr(vptree, "BLOCK", 20)
    monkeypatch.setattr(vptree, "SAMPLE", 1000)
    draw = np.random.default_rng(6)
    x = draw.normal(size=(3000, 24))
    if kind == "clusters":
        x = draw.normal(size=(40, 24))[draw.integers(40, size=3000)] + 0.05 * x
    elif kind == "low rank":
        x = draw.normal(size=(3000, 4)) @ draw.normal(size=(4, 24)) + 0.001 * x
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {(r["query_id"], r["vec_id"]) for r in vptree.nearest(table(spark, rows), F.col("vec_id") % 50 == 0).collect()}
    own = dict(rows)
    want = {(w[0], w[2]) for w in plain_nearest([(i, np.float32(v).astype(float).tolist()) for i, v in own.items()], 10, 50)}
    assert len(got & want) / len(want) >= 0.95 and len(got) == len(want)
    if kind != "round":
        tree = vptree.Tree(x, np.arange(3000))
        tree.search(x[::50], np.arange(0, 3000, 50), 10, vptree.fitting_factor(x[:1000], 10))
        assert tree.visited < 0.5 * 60 * 3000


def test_repeated_ids_do_not_depend_on_partitions(spark):
    draw = np.random.default_rng(3)
    rows = [(i % 150, np.round(draw.normal(size=3), 2).tolist()) for i in range(400)]
    least = {i: min(np.float32(v).tolist() for j, v in rows if j == i) for i in range(150)}
    want = plain_nearest(sorted(least.items()), 10, 50)
    for parts in (1, 4):
        got = sorted(tuple(r) for r in vptree.nearest(table(spark, rows).repartition(parts), F.col("vec_id") % 50 == 0, factor=1.0).collect())
        assert [g[:3] for g in got] == [w[:3] for w in want]


def test_recall(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    got = {(r["query_id"], r["vec_id"]) for r in vptree.nearest(table(spark, rows), F.col("vec_id") % 100 == 0).collect()}
    want = {(w[0], w[2]) for w in plain_nearest(rows, 10, 100)}
    assert len(got & want) / len(want) >= 0.9 and len(got) == len(want)


def test_unusable_vectors(spark):
    rows = [(0, [1.0, 0.0]), (100, None), (200, [0.0, 0.0]), (300, [float("nan"), 1.0]), (1, [float("inf"), 1.0]), (2, [None, 1.0]), (3, [1.0, 1.0]), (None, [1.0, 0.0]), (4, [1.0]), (3, [1.0, 1.0]), (400, [])]
    got = [tuple(r) for r in vptree.nearest(table(spark, rows), F.col("vec_id") % 100 == 0).collect()]
    assert got == [(0, 1, 3, 1.0)]
    assert vptree.nearest(table(spark, []), F.col("vec_id") % 100 == 0).count() == 0
