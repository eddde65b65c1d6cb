"""Incremental maintenance: what changed, which rows stay, which vectors can be used again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import extension

#: Paths that are sent to every task, at most.
PATHS = 200_000
#: Bytes of rows that are numbered together, about, and those of a row besides its text; sampled keys a range; letters of a text in a key.
RANGE, ROW, DRAWN, PREFIX = 1 << 24, 256, 32, 256


def manifest_diff(current: DataFrame, known: DataFrame) -> DataFrame:
    """path, status (new, changed, same, deleted) of two listings with path, mtime and size.

    A file whose mtime or size is unknown on either side counts as changed. One shuffle by path.
    """
    now = current.select("path", F.col("mtime").alias("mtime_now"), F.col("size").alias("size_now"), F.lit(True).alias("is_now"))
    was = known.select("path", F.col("mtime").alias("mtime_was"), F.col("size").alias("size_was"), F.lit(True).alias("was"))
    same = (F.col("mtime_now") == F.col("mtime_was")) & (F.col("size_now") == F.col("size_was"))
    status = (
        F.when(F.col("was").isNull(), "new").when(F.col("is_now").isNull(), "deleted").when(F.coalesce(same, F.lit(False)), "same").otherwise("changed")
    )
    return now.join(was, "path", "full_outer").select("path", status.alias("status"))


def retained(chunks: DataFrame, diff: DataFrame) -> DataFrame:
    """Chunks of files that are still there and unchanged. Paths are sent to every task if they are
    few, so that a file of many chunks is not one task's."""
    same = diff.where(F.col("status") == "same").select(F.col("path").alias("file"))
    if same.count() <= PATHS:
        same = F.broadcast(same)
    return chunks.join(same, "file", "left_semi").select(chunks.columns)


def to_parse(diff: DataFrame) -> DataFrame:
    return diff.where(F.col("status").isin("new", "changed")).select("path")


def _bounds(rows: DataFrame, key: Column) -> list[Column]:
    """Keys in order that part the rows into ranges of about RANGE bytes. They are taken from a
    sample of the keys, which decides how rows are dealt to tasks and nothing else."""
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + F.lit(ROW))
    n, total = rows.agg(F.count("*"), size).collect()[0]
    parts = -(-(total or 0) // RANGE)
    if parts < 2:
        return []
    drawn = rows.select(key.alias("key")).sample(min(1.0, DRAWN * parts / n), 7)
    ordered = drawn.agg(F.sort_array(F.collect_list("key")).alias("keys")).select(F.filter("keys", lambda _, i: i % DRAWN == DRAWN - 1).alias("keys"))
    fields = drawn.schema["key"].dataType.fields
    return [F.struct(*[F.lit(k[f.name]).cast(f.dataType).alias(f.name) for f in fields]) for k in ordered.collect()[0]["keys"]]


def _range_of(key: Column, bounds: list[Column]) -> Column:
    """How many of the bounds are not above the key, by halving."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    every = F.array(*bounds)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda low, step: F.when(F.get(every, low + step - 1) <= key, low + step).otherwise(low))


def appended(kept: DataFrame, fresh: DataFrame) -> DataFrame:
    """Kept and new chunks with row numbers by file and lines, so that a rebuild numbers them alike.

    Numbers are dealt per index. Rows are parted into ranges of their order by fixed bounds, and
    are numbered within a range from the counts of the ranges before it, so that no task holds a
    whole index or file. Both sides are read some times: to find bounds, to count, and to number.
    """
    every = kept.unionByName(fresh)
    lines = [F.asc_nulls_first("start_line"), F.asc_nulls_first("end_line")]
    # nulls are first in a struct's order too, and a text's beginning is ordered as the text
    key = F.struct("index_id", "file", "start_line", "end_line", F.substring("text", 1, PREFIX).alias("text"))
    dealt = every.withColumn("range", _range_of(key, _bounds(every, key)))
    before = Window.partitionBy("index_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("index_id", "range").agg(F.count("*").alias("rows"))
    offsets = counts.select(F.col("index_id").alias("index"), F.col("range").alias("at"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("index_id", "range").orderBy("file", *lines, "text")) - 1
    here = F.col("index_id").eqNullSafe(F.col("index")) & (F.col("range") == F.col("at"))
    numbered = dealt.drop("row_id").withColumn("place", place).join(F.broadcast(offsets), here)  # a row an index and range
    return numbered.withColumn("row_id", (F.col("offset") + F.col("place")).cast("long")).select(kept.columns)


def reused_vectors(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """``chunks`` (with a column hash) and the cached vector of that hash, null where it must be computed."""
    return chunks.join(cache.select("hash", "vector").dropDuplicates(["hash"]), "hash", "left")


def index_statistics(chunks: DataFrame) -> DataFrame:
    """index_id, files, chunks, bytes."""
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return chunks.groupBy("index_id").agg(F.countDistinct("file").alias("files"), F.count("*").alias("chunks"), F.sum(size).alias("bytes"))


def within_budget(statistics: DataFrame, budget: int) -> DataFrame:
    """index_id, bytes, running, fits: the largest indexes first, as far as they fit together.

    The window runs over one row an index, after the aggregation.
    """
    running = F.sum("bytes").over(Window.orderBy(F.desc("bytes"), "index_id").rowsBetween(Window.unboundedPreceding, 0))
    return statistics.select("index_id", "bytes", running.alias("running")).withColumn("fits", F.col("running") <= budget)


def files_per_extension(files: DataFrame) -> DataFrame:
    return files.select(extension(F.col("path")).alias("extension")).groupBy("extension").agg(F.count("*").alias("files"))
