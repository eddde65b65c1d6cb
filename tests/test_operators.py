"""Laws and hand-computed cases of retrieval; every registered query against its SQL."""

import glob
import math
import os
import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import bm25, chunking, fusion, search, vector
from quarry.plans import catalogue
from quarry.sources.files import is_excluded, list_files
from quarry.sources.store import Store

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, tables, name):
    df = catalogue.QUERIES[name](spark, DATA)
    other = tables.sql(catalogue.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(other.columns)
    ours = sorted(repr([r[c] for c in columns]) for r in df.collect())
    at = [other.columns.index(c) for c in columns]
    assert ours == sorted(repr([r[i] for i in at]) for r in other.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


# -- BM25 -----------------------------------------------------------------------------------

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu".split()


def corpus(seed, n, index):
    draw = random.Random(seed)
    return [(index, i, f"/{index}/f{i}.py", " ".join(draw.choices(WORDS, k=draw.randint(5, 39)))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "index_id string, row_id long, file string, text string")


def expected(rows, question):
    """Plain BM25 over rows as one index."""
    docs = [r[3].split() for r in rows]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = {w: sum(w in d for d in docs) for d in docs for w in d}
    raw = {w: math.log(n - k + 0.5) - math.log(k + 0.5) for w, k in df.items()}
    mean = sum(raw.values()) / len(raw)
    out = []
    for d in docs:
        s = 0.0
        for w in question.split():
            if w in df:
                idf = raw[w] if raw[w] >= 0 else 0.25 * mean
                s += idf * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg))
        out.append(s)
    return out


def test_one_index_scores_plainly(spark):
    rows = corpus(1, 40, "a") + [("a", 40, "/a/f40.py", "rare alpha rare")]
    c = frame(spark, rows)
    q = bm25.question_terms(spark, "rare alpha rare beta")
    got = {r["row_id"]: r["score"] for r in bm25.scores(bm25.matches(c, "rare alpha rare beta"), bm25.Statistics.of(c), q).collect()}
    for i, s in enumerate(expected(rows, "rare alpha rare beta")):
        assert got.get(i, 0.0) == pytest.approx(max(s, 0.0), abs=1e-8)


def test_two_indexes_score_as_one(spark):
    a, b = corpus(2, 20, "a"), corpus(3, 20, "b")
    a[3] = (*a[3][:3], a[3][3] + " zebra")
    b[5] = (*b[5][:3], b[5][3] + " zebra zebra")
    q = bm25.question_terms(spark, "zebra")

    def scored(rows):
        c = frame(spark, rows)
        return sorted((r["score"] for r in bm25.scores(bm25.matches(c, "zebra"), bm25.Statistics.of(c), q).collect()))

    joined = [("j", i, f, t) for i, (_, _, f, t) in enumerate(a + b)]
    assert scored(a + b) == pytest.approx(scored(joined), rel=1e-6)
    assert len(scored(a + b)) == 2 and scored(a + b) != pytest.approx(sorted(scored(a) + scored(b)), rel=1e-3)


def test_stored_postings_score_alike(spark):
    c = frame(spark, corpus(5, 30, "a") + corpus(6, 20, "b"))
    q = bm25.question_terms(spark, "alpha mu mu nowhere")
    stored = bm25.postings(c).join(bm25.lengths(c), ["index_id", "row_id"])
    by_question = bm25.scores(bm25.matches(c, "alpha mu mu nowhere"), bm25.Statistics.of(c), q)
    assert sorted(map(tuple, bm25.scores(stored, bm25.Statistics.of(c), q).collect())) == sorted(map(tuple, by_question.collect()))


def test_stored_indexes_answer_as_raw_chunks_do(spark, tmp_path):
    from quarry.operators import stored
    from quarry.plans.indexed import build

    rows = [(*r, [float(i % 7), float(i % 3)]) for i, r in enumerate(corpus(7, 30, "a") + corpus(8, 20, "b"))]
    c = spark.createDataFrame(rows, "index_id string, row_id long, file string, text string, vector array<double>")
    s = Store(spark, str(tmp_path / "i"))
    build(s, c)
    own = stored.StoredIndexes(*[s.read(t) for t in ("chunks", "postings", "frequencies", "sizes")])
    q = spark.createDataFrame([([1.0, 0.5],)], "query array<double>")
    plan = own.postings.where(F.col("term").isin("alpha"))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term" in plan or "EqualTo(term" in plan
    for question in ("alpha mu mu nowhere", "nowhere", "", "kappa"):
        assert list(map(tuple, own.keyword(question, 9).orderBy("rank").collect())) == list(map(tuple, bm25.search(c, question, 9).orderBy("rank").collect()))
        for some, raw in ((own, c), (own.only("b"), c.where("index_id = 'b'"))):
            for folder in (None, "/b/f1"):
                ours = some.hybrid(q, question, 6, folder).orderBy("rank").collect()
                assert list(map(tuple, ours)) == list(map(tuple, search.hybrid(raw, q, question, 6, folder).orderBy("rank").collect()))
    assert own.only("none").keyword("alpha", 5).count() == 0


def test_postings_shuffle_texts_alone(spark, monkeypatch):
    from quarry.operators import stored

    rows = corpus(9, 60, "a") + [("a", 70, "f", None), ("b", 0, "f", "?!"), (None, 1, "f", "mu mu"), ("a", 0, "f", "one id"), ("a", 0, "f", "two texts")]
    c = frame(spark, rows)
    monkeypatch.setattr(stored, "SEGMENT", 500)
    parts = stored.segments(c)
    assert parts == -(-sum(len(r[3].encode()) for r in rows if r[3]) // 500) > 4
    found = stored.postings(c)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and f", {parts})" in plan.split("Exchange ")[1].split("\n")[0]
    assert "regexp_extract_all" not in plan.split("Exchange ")[1], "texts are tokenized after the shuffle, and once"
    by_id = lambda d, *c: sorted(map(str, d.select(*c).collect()))
    once = frame(spark, [r for r in rows if r[3] not in ("one id", "two texts")])
    assert by_id(stored.postings(once), "index_id", "row_id", "term", "tf") == by_id(bm25.postings(once), "index_id", "row_id", "term", "tf")
    assert {(r["term"], r["length"], r["tf"]) for r in found.where("index_id = 'a' and row_id = 0").collect()} >= {("one", 2, 1), ("two", 2, 1)}


def test_sizes_read_no_text(spark):
    from quarry.operators import stored

    c = frame(spark, corpus(9, 20, "a") + [("a", 70, "f", None), ("b", 0, "f", "?!"), (None, 1, "f", "mu mu")])
    p = stored.postings(c).select("index_id", "row_id", "length", "term", "tf")
    kept = spark.createDataFrame(p.collect(), p.schema)
    own = stored.sizes(c.drop("text"), kept, stored.frequencies(kept))
    sizes = lambda d: sorted(map(str, d.select("index_id", "n", "total_length").collect()))
    assert sizes(own) == sizes(bm25.index_sizes(c)) and own.count() == 3


def test_an_index_moves_less_than_its_texts_twice(spark, tmp_path):
    def moved(n):
        """MB of text, shuffled, spilled and written by a question to two languages, and by the build of the index that it asks."""
        draw, words = random.Random(n), [f"{a}{b}{c}" for a in "brklmnstvz" for b in "aeiou" for c in WORDS] + ["shou", "lynt"]
        rows = [(i, " ".join(draw.choices(words, k=draw.randint(50, 350))), ("en", "fr", "de", "es")[i % 4], "web") for i in range(n)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/{n}/documents.parquet")
        sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

        def stages():
            sc.listenerBus().waitUntilEmpty(30_000)
            every = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
            return {x.stageId(): x for x in (every.apply(i) for i in range(every.size()))}

        before = max(stages(), default=-1)
        found = catalogue.QUERIES["bm25_multi_index"](spark, f"{tmp_path}/{n}").collect()
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/{n}/documents.parquet/*.parquet'")
        assert len(found) == 30 and sorted(map(tuple, found)) == sorted(con.sql(catalogue.ORACLES["bm25_multi_index"]).fetchall())
        own = [x for k, x in stages().items() if k > before]
        return [sum(len(r[1]) for r in rows) / 1e6, *(sum(getattr(x, f)() for x in own) / 1e6 for f in ("shuffleWriteBytes", "diskBytesSpilled", "outputBytes"))]

    small, large = moved(400), moved(1600)
    for text, shuffled, spilled, written in (small, large):
        assert shuffled < text and spilled == 0 and shuffled + written < 2 * text
    assert sum(large[1:]) <= 1.1 * large[0] / small[0] * sum(small[1:])


def test_texts_without_a_vector_are_not_shuffled(spark, tmp_path, monkeypatch):
    from quarry.plans import corpora

    d = [(i, f"text {i}", "en", "web") for i in range(40)]
    spark.createDataFrame(d, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [1.0]) for i in (3, 5, 5, 99)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = corpora.hybrid_chunks(spark, str(tmp_path))
        assert "BroadcastHashJoin [row_id" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "LeftSemi" in plan
        monkeypatch.setattr(corpora, "IDS", 2)
        plain = corpora.hybrid_chunks(spark, str(tmp_path))
        assert "LeftSemi" not in plain._jdf.queryExecution().executedPlan().toString()
        rows = [sorted(map(str, x.collect())) for x in (found, plain)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows[0] == rows[1] and len(rows[0]) == 3


def test_one_file_is_numbered_by_many_tasks(spark, monkeypatch):
    from quarry.operators import maintain

    draw = random.Random(3)
    rows = [("a", 0, "/a/big.py", draw.choice([None, n // 3]), draw.choice([None, n]), f"{'same ' * draw.choice([0, 60])}{n % 50}é") for n in range(600)]
    rows += [("b", 0, f"/b/{n % 4}.py", n, n, "x") for n in range(40)] + [("a", 0, "/a/first.py", 1, 1, None)]
    schema = "index_id string, row_id long, file string, start_line int, end_line int, text string"
    draw.shuffle(rows)
    kept, fresh = spark.createDataFrame(rows[:500], schema), spark.createDataFrame(rows[500:], schema)
    first = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    ordered = sorted(rows, key=lambda r: (r[0], *map(first, r[2:])))
    numbered = [(r[0], n if r[0] == "a" else n - 601, *r[2:]) for n, r in enumerate(ordered)]
    assert sorted(map(repr, map(tuple, maintain.appended(kept, fresh).collect()))) == sorted(map(repr, numbered))
    monkeypatch.setattr(maintain, "RANGE", 20_000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = maintain.appended(kept, fresh).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(repr(tuple(r)[:-1]) for r in found) == sorted(map(repr, numbered))
    assert len({r["task"] for r in found if r["file"] == "/a/big.py"}) > 1


def test_few_paths_are_sent_to_every_task(spark, monkeypatch):
    from quarry.operators import maintain

    chunks = spark.createDataFrame([(n, f"f{n % 3}") for n in range(9)], "row_id long, file string")
    diff = spark.createDataFrame([("f0", "same"), ("f1", "changed"), ("f2", "same"), ("f9", "same")], "path string, status string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = maintain.retained(chunks, diff)
        assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(maintain, "PATHS", 1)
        assert sorted(found.collect()) == sorted(maintain.retained(chunks, diff).collect()) and found.count() == 6
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty_question_and_empty_collection(spark):
    c = frame(spark, corpus(4, 10, "a"))
    assert bm25.search(c, "?!", 5).count() == 0
    assert bm25.search(c.limit(0), "alpha", 5).count() == 0
    o = bm25.Statistics.of(c.limit(0)).overall.collect()[0]
    assert (o["n"], o["avgdl"], o["idf_mean"]) == (0, 1.0, 0.0)


def test_floor_and_zero(spark):
    c = frame(spark, [("a", i, "f", t) for i, t in enumerate(["x y z", "x y", "x", "x"])])
    got = {r["term"]: r["idf"] for r in bm25.Statistics.of(c).idf(bm25.question_terms(spark, "x y z nowhere")).collect()}
    mean = (-2.1972245773362196 + 0.0 + 0.8472978603872034) / 3
    assert got["y"] == 0.0 and got["z"] == pytest.approx(0.8472978603872034) and got["x"] == pytest.approx(0.25 * mean) and len(got) == 3


# -- fusion ---------------------------------------------------------------------------------


def lists(spark):
    n = spark.createDataFrame([("i", r, k) for k, r in enumerate([0, 1, 2], 1)], "index_id string, row_id long, rank int")
    k = spark.createDataFrame([("i", 2, 1), ("i", 3, 2)], "index_id string, row_id long, rank int")
    return fusion.fuse(n, k)


def test_fusion_by_hand(spark):
    fused = lists(spark)
    got = [(r["row_id"], round(r["fused"], 12)) for r in fusion.head(fused, 10).orderBy("rank").collect()]
    assert got == [(2, round(1 / 63 + 1 / 61, 12)), (0, round(1 / 61, 12)), (1, round(1 / 62, 12)), (3, round(1 / 62, 12))]


def test_penalty_by_hand(spark):
    paths = {0: "a.py", 1: "b.py", 2: "tests/c.py", 3: "specs/d.md"}
    named = lists(spark).join(spark.createDataFrame(list(paths.items()), "row_id long, file string"), "row_id")
    order = lambda asks: [r["row_id"] for r in fusion.head(fusion.weighted(named, F.col("file"), F.lit(asks)), 10).orderBy("rank").collect()]
    assert order(False) == [0, 2, 1, 3] and order(True) == [2, 0, 1, 3]


def test_exact_name_survives_a_distant_vector(spark):
    near = [("a", i, f"/a/f{i}.py", "some words", [1.0, 0.01 * i]) for i in range(30)]
    far = [("b", i, f"/b/f{i}.py", "other words", [0.5, 0.5]) for i in range(29)] + [("b", 29, "/b/exact.py", "parse_widget here", [-1.0, 0.0])]
    c = spark.createDataFrame(near + far, "index_id string, row_id long, file string, text string, vector array<double>")
    q = spark.createDataFrame([([1.0, 0.0],)], "query array<double>")
    assert "/b/exact.py" in [r["file"] for r in search.hybrid(c, q, "parse_widget", 5).collect()]
    assert search.hybrid(c, q, "zzz", 5).count() == 5
    assert search.hybrid(c, q, "parse_widget", 5, "/nowhere").count() == 0


def test_vectors_have_no_threshold(spark):
    v = spark.createDataFrame([("a", i, [float(-i), 1.0]) for i in range(4)], "index_id string, row_id long, vector array<double>")
    got = vector.search(v, spark.createDataFrame([([1.0, 0.0],)], "query array<double>"), 9)
    assert [(r["row_id"], r["score"]) for r in got.orderBy("rank").collect()] == [(0, 0.0), (1, -1.0), (2, -2.0), (3, -3.0)]


# -- scalar functions -----------------------------------------------------------------------


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).collect()[0]


def test_tokens(spark):
    cases = {"fooBar": ["foo", "bar"], "HTTPServer2Foo": ["httpserver2foo"], "9a": ["9", "a"], "_x_1": ["_x_1"], "École": ["cole"], "Привет": [], "a-b": ["a", "b"]}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", tx.ident_tokens(F.col("t")).alias("w")).collect()
    assert {r["t"]: r["w"] for r in got} == cases


def test_html_keeps_lines(spark):
    html = "<p>a</p>\n<SCRIPT>x\ny\n</Script >b<!-- 1\n2 --> c\t d\n<svg><g/></svg><style>z</style>e <!-- open"
    r = one(spark, t=tx.strip_html(F.lit(html)), kept=tx.clean_text(F.lit(html), F.lit("a.md")), cut=tx.clean_text(F.lit(html), F.lit("a.HTML")))
    assert r["t"].split("\n") == ["a", "", "", "b", "c d", "e <!-- open"] and r["kept"] == html
    assert r["cut"] == chunking.clean(html, "a.HTML") == r["t"]


def test_payload_of_a_hundred(spark):
    r = one(spark, short=tx.strip_data_uri(F.lit("data:a/b;base64," + "A" * 99)), long=tx.strip_data_uri(F.lit("data:a/b;base64," + "A" * 100 + "!")))
    assert r["short"].endswith("A") and r["long"] == "data:a/b;base64,!"


@given(st.text("ab/*?[]!.-^\\", max_size=8), st.text("ab/.-]^", max_size=8))
@settings(max_examples=200, deadline=None)
def test_globs_match_as_the_shell_module_does(pattern, name):
    import re
    from fnmatch import fnmatchcase

    assert bool(re.match(tx.glob_regex(pattern), name)) == fnmatchcase(name, pattern)


def test_globs_match_alike_in_the_engine(spark):
    from fnmatch import fnmatchcase

    patterns = ["[!]", "[!]a]", "[]a]", "[b-a]", "[!b-a]", "[a-c]x", "[^a]", "[a&&b]", "[[]", "[a[b]", "[\\\\]", "a[", "[]", "[!", "*.min.js", "a?c", "[--0]", "[a-]", "x{1}", "a.b", "[a-c-e]"]
    names = ["", "!", "]", "a", "b", "c", "e", "-", "&", "[", "\\", "ax", "bx", "^", "a[", "[]", "[!", "[!]", "x.min.js", "abc", "a\nc", "x{1}", "axb", "a.b", ".", "a\n"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", *[F.col("n").rlike(tx.glob_regex(p)).alias(f"p{i}") for i, p in enumerate(patterns)]).collect()
    assert {(r["n"], p): r[f"p{i}"] for r in got for i, p in enumerate(patterns)} == {(n, p): fnmatchcase(n, p) for n in names for p in patterns}


def test_exclusion(spark):
    cases = [("src/x.min.js", True), ("mcp/data/deep/a.json", True), ("mcp/database/a.json", False), ("a/deep/b", True), ("deeper/b", False)]
    patterns = ["*.min.js", "mcp/data/", "deep"]
    got = spark.createDataFrame([(p,) for p, _ in cases], "p string").select("p", tx.excluded(F.col("p"), patterns).alias("x")).collect()
    assert [(r["p"], r["x"]) for r in got] == cases == [(p, is_excluded(p, patterns)) for p, _ in cases]


# -- chunking -------------------------------------------------------------------------------


@given(st.lists(st.sampled_from(["a", "bb. ", "c, ", "\n", "\n\n", " ", "word "]), max_size=60).map("".join), st.integers(1, 7), st.integers(0, 5))
@settings(max_examples=200, deadline=None)
def test_chunks_cover_the_text(text, most, overlap):
    size = chunking.Ruler(chunking.word_starts(text))
    spans = chunking.cuts(text, 0, len(text), size, most)
    assert [a for a, _ in spans] == [0, *[b for _, b in spans[:-1]]] and spans[-1][1] == len(text)
    assert all(size(a, b) <= most for a, b in spans)
    chunks = chunking.packed(spans, size, most, overlap)
    assert chunks[0][0] == 0 and chunks[-1][1] == len(text)
    for (a, b), (c, d) in zip(chunks, chunks[1:], strict=False):
        assert a <= c <= b < d and size(c, b) <= overlap
    assert all(size(a, b) <= most for a, b in chunks)


def test_chunk_sizes():
    for n, count in ((449, 1), (450, 1), (451, 2), (1500, 4)):
        text = " ".join(f"w{i}" for i in range(n))
        found = list(chunking.chunks_of("/r/a.txt", "a.txt", text.encode()))
        assert len(found) == count and found[0][2].startswith("# file: a.txt | language: text\nw0 w1")


def test_sections_name_their_ancestors():
    assert [(s[2]) for s in chunking.markdown("x\n# A\n### B\n# C")] == ["/", "/", "/A/", "/"]
    text = "# A\n```\n# no\n```\n## B\nt\n"
    assert [(text[a:b], p) for a, b, p in chunking.markdown(text)] == [("# A\n```\n# no\n```\n", "/"), ("## B\nt\n", "/A/")]


def test_python_declarations():
    source = "import os\n\n# note\nX = '''a\n\nb'''\n\n@deco\ndef f():\n    return 1\n\n\nclass C:\n    y = 2\n    def m(self):\n        pass\n\nprint(f())\n"
    got = chunking.python_chunks(source)
    assert [(s, a, b) for s, a, b, _ in got] == [("preamble", 1, 7), ("function f", 8, 10), ("class C", 13, 16), ("preamble", 18, 19)]
    assert got[0][3] == "import os\n# note\nX = '''a\n\nb'''"
    long = "class D:\n    z = 1\n" + "".join(f"    def m{i}(self):\n" + "        pass\n" * 20 for i in range(9))
    found = chunking.python_chunks(long)
    assert found[0][:3] == ("class D", 1, 191) and found[0][3] == "class D:\n    z = 1" and found[1][0] == "D.m0" and len(found) == 10
    assert chunking.python_chunks("def broken(:") is None
    assert list(chunking.chunks_of("/a.py", "a.py", b"def broken(:"))[0][2].startswith("# file: a.py | language: python\n")


# -- files and stores -----------------------------------------------------------------------


def test_listing(tmp_path):
    for rel in ("a.py", "X.MD", "__init__.py", ".github/ci.yml", "env/pyvenv.cfg", "env/lib/s.py", "foo.egg-info/t.txt", "build/b.py", "sub/c.min.js", "sub/d.js"):
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text("x")
    names = lambda **k: [os.path.relpath(f, tmp_path) for f in list_files(str(tmp_path), **k)[0]]
    assert sorted(names(exclude=["*.min.js"])) == [".github/ci.yml", "__init__.py", "a.py", "foo.egg-info/t.txt", "sub/d.js"]
    assert names(root_only=True) == ["__init__.py", "a.py"]


def test_store_generations(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    assert s.generation() is None and s.read("t") is None
    s.write({"t": spark.range(3)})
    old = s.read("t")
    assert s.write({"t": spark.range(5)}) == 2 and old.count() == 3 and s.read("t").count() == 5
    with pytest.raises(Exception):
        s.write({"t": spark.range(1).select(F.expr("raise_error('x')"))})
    assert s.generation() == 2
    (tmp_path / "s" / "CURRENT").write_text("?")
    (tmp_path / "s" / ".CURRENT.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError):
        s.generation()
