"""What the operators of this folder share: tables, scratch space, samples."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a training sample over all labels, at most; leading bits of the hash that draws them by which they are counted first.
SAMPLE_ROWS, SAMPLE_BITS = 50_000, 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; an own one only in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="scratch-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Tables that this process has written to scratch folders.
_written: list[str] = []


def release(spark: SparkSession) -> int:
    """Delete the scratch tables of this process; only once no result that reads them is needed."""
    jvm, conf, done = spark._jvm, spark._jsc.hadoopConfiguration(), len(_written)
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)
    return done


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back, cutting its lineage.

    The written files outlive executors, so a lost one costs only its running tasks.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def sample_table(docs: DataFrame, labels: DataFrame, keep: Column, per_class: int, seed: int) -> DataFrame | None:
    """At most ``per_class`` rows (doc_id, label, draw, text) of each label value, chosen by a hash of the id.

    ``labels`` has doc_id and label; ``keep`` is a condition on doc_id. An id with several
    labels counts with the largest, an id with several texts with the smallest. All rows are
    drawn from, texts of any length among them, and every label value has its rows: where
    there are so many values that all would be more than SAMPLE_ROWS, each has fewer, and
    beyond SAMPLE_ROWS values this is an error. None where no row has a label.
    """
    ids = docs.where(keep & F.col("text").isNotNull()).select("doc_id").distinct()
    known = labels.where(F.col("label").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    drawn = ids.join(known, "doc_id").withColumn("draw", F.xxhash64("doc_id", F.lit(seed)))
    drawn = drawn.withColumn("part", F.shiftrightunsigned("draw", 64 - SAMPLE_BITS).cast("int"))
    # as many of each label's parts as hold its first rows, so that no task sorts all of a label
    before = Window.partitionBy("label").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = drawn.groupBy("label", "part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    first = drawn.join(parts.where(F.col("before") < per_class).select("label", "part"), ["label", "part"], "left_semi")
    rank = F.row_number().over(Window.partitionBy("label").orderBy("part", "draw", "doc_id"))
    picked = materialize(first.withColumn("rank", rank).where(F.col("rank") <= per_class).select("doc_id", "label", "draw", "rank"), "sample")
    values = picked.select("label").distinct().count()
    if not values:
        return None
    if values > SAMPLE_ROWS:
        raise ValueError(f"{values} label values; a sample has at most {SAMPLE_ROWS} rows")
    picked = picked.where(F.col("rank") <= SAMPLE_ROWS // values).drop("rank")  # at most SAMPLE_ROWS
    return (
        docs.where(F.col("text").isNotNull())
        .select("doc_id", "text")
        .join(F.broadcast(picked), "doc_id")
        .groupBy("doc_id", "label", "draw")
        .agg(F.min("text").alias("text"))
    )


def in_order(rows: Iterable[tuple]) -> list[tuple[str, object]]:
    """(text, label) of rows (draw, doc_id, text, label), by the hash, however they were partitioned."""
    return [(text, label) for _, _, text, label in sorted(rows, key=lambda r: r[:2])]


def labelled_sample(docs: DataFrame, labels: DataFrame, keep: Column, per_class: int, seed: int) -> list[tuple[str, object]]:
    """The (text, label) rows of ``sample_table`` on the driver, in order."""
    sample = sample_table(docs, labels, keep, per_class, seed)
    return [] if sample is None else in_order(tuple(r) for r in sample.select("draw", "doc_id", "text", "label").collect())


def trained(sample: DataFrame | None, train: Callable[[list[tuple[str, object]]], object]) -> object:
    """What ``train`` makes of a ``sample_table``, by one task on an executor.

    The task holds the sample, SAMPLE_ROWS texts at most; the driver gets the model alone. A
    task that is lost is done again with the same outcome, as the rows are put in order first.
    """
    if sample is None:
        return train([])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for batch in batches for row in zip(*(batch[c].tolist() for c in batch), strict=True))
        yield pd.DataFrame({"model": [pickle.dumps(train(in_order(rows)))]})

    made = sample.select("draw", "doc_id", "text", "label").coalesce(1).mapInPandas(run, "model binary")
    return pickle.loads(made.collect()[0]["model"])


def chunks(texts: Iterable[str | None], limit: int = 1 << 19) -> Iterator[list[bytes]]:
    """UTF-8 texts in order, in lists of about ``limit`` bytes (null: empty)."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        raw = text.encode("utf-8", "replace") if isinstance(text, str) else b""
        held.append(raw)
        size += len(raw)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held
