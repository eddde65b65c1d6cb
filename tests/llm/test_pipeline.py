"""The corpus pipeline, stage by stage against plain judges, and on odd tables."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import quality, toxicity
from quarry.llm.common import materialize

from .conftest import DOCS, ODD, prose
from .test_models import plain_quality, plain_toxicity
from .test_tokens import check_packing
from .test_words import plain_contamination, plain_groups, plain_print

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def judged(rows, stage, fitted, items):
    """What of (id, text) rows a stage keeps, text by text; the networks are those that it fits."""
    if stage == "quality":
        return [r for r in rows if plain_quality(fitted, r[1] or "") >= quality.THRESHOLD]
    if stage == "toxicity":
        return [r for r in rows if plain_toxicity(fitted, r[1] or "") < toxicity.THRESHOLD]
    if stage == "near_duplicates":
        groups = plain_groups({i: plain_print(t) for i, t in rows})
        return [r for r in rows if groups[r[0]] == r[0]]
    return [r for r, hit in zip(rows, plain_contamination(rows, items), strict=True) if hit[3] == 0]


def test_stages_keep_what_plain_judges_keep(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        fitted = {"quality": quality, "toxicity": toxicity}[name].fit(docs, labels) if name in ("quality", "toxicity") else None
        out = materialize(stage(spark, docs, SF), name)
        assert out.columns == docs.columns
        assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == sorted(judged(rows, name, fitted, items))
        docs = out
        sizes.append(docs.count())
    assert all(a > b for a, b in zip(sizes, sizes[1:], strict=False)), sizes
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert check_packing(rows, STAGES["packing"](spark, docs, SF).collect(), model, 1024) < 0.1
    got = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in got.select("doc_id").distinct().collect()} == {i for i, _ in rows}


@pytest.fixture(scope="module")
def odd_folder(spark, tmp_path_factory):
    """Labels and items with nulls and repeats; items that stand in one text each, once in part."""
    folder = str(tmp_path_factory.mktemp("odd"))
    known = [(i, i % 2, int(i % 5 == 0)) for i in range(1000, 1060)] + [(1000, 1, 1), (None, 1, 1), (1001, None, None)]
    spark.createDataFrame(known, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(1, prose(901, 12)), (2, prose(902, 20)), (2, prose(903, 9)), (None, "same words again and again"), (3, None), (4, ""), (5, "tiny item")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, items


def odd_rows():
    trained = [(i, (prose(i, 30) if i % 2 else "buy buy now now " * 8) + (" rotten vilebeast" if i % 5 == 0 else "")) for i in range(1000, 1060)]
    planted = [(30, prose(1, 9) + " " + prose(902, 20).upper()), (31, prose(2, 9) + " " + " ".join(prose(901, 12).split()[:7])), (32, "a tiny, item"), (33, prose(903, 9)), (None, prose(901, 12))]
    return [*ODD, *trained, *planted]


def frame(spark, rows):
    """With columns whose names clash with those that stages make."""
    extra = "score string, key string, root string, fp string, marks string, label string, rank string"
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *"abcdefg") for i, t in rows], f"{DOCS}, {extra}").repartition(3)


@pytest.mark.parametrize("name", [n for n in STAGES if n != "packing"])
def test_stages_on_odd_rows(spark, odd_folder, name):
    folder, items = odd_folder
    docs = frame(spark, odd_rows())
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    fitted = {"quality": quality, "toxicity": toxicity}[name].fit(docs, labels) if name in ("quality", "toxicity") else None
    out = STAGES[name](spark, docs, folder)
    got = sorted(map(repr, ((r["doc_id"], r["text"]) for r in out.collect())))
    assert out.columns == docs.columns
    if name == "near_duplicates":
        prints = {i: plain_print(t) for i, t in odd_rows() if i is not None}
        kept = {i for i, root in plain_groups(prints).items() if i == root}
        assert sorted(r for r in got if "None," not in r) == sorted({repr(r) for r in odd_rows() if r[0] in kept})
        assert sum("(None," in r for r in got) == 2  # unlike texts without an id
    else:
        assert got == sorted(map(repr, judged(odd_rows(), name, fitted, [i for i in items if i[0] is not None])))
    assert STAGES[name](spark, docs.limit(0), folder).count() == 0


def test_pipeline_on_odd_tables(spark, odd_folder, tmp_path, model):
    folder, _ = odd_folder
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{table}.parquet").write.parquet(f"{tmp_path}/{table}.parquet")
    frame(spark, odd_rows()).write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {30, 32, 33}.isdisjoint({p["doc_id"] for p in pieces}) and len({p["sequence_id"] for p in pieces}) >= 1
    frame(spark, odd_rows()).limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
