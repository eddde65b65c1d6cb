"""Hybrid search: keywords and vectors over any number of indexes, as one collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import location, relative_path, wants_tests
from . import bm25, fusion, vector


def in_folder(path: Column, root: Column | None, folder: str) -> Column:
    """A raw prefix of the absolute path, or of the path below the index's root."""
    hit = path.startswith(folder)
    return hit if root is None else hit | relative_path(path, root).startswith(folder)


def hybrid(
    chunks: DataFrame,
    query: DataFrame,
    question: str,
    k: int,
    folder: str | None = None,
    statistics: bm25.Statistics | None = None,
    postings: DataFrame | None = None,
) -> DataFrame:
    """rank, index_id, row_id, file, fused of the k best chunks.

    ``chunks`` has index_id, row_id, file, text, vector and, if indexes have one, root; ``query``
    is one row with the question's vector (column query). Rows without a vector take no part.
    Statistics and postings (with length) are computed unless a stored index provides them. Both
    retrievers carry identities and scores only; paths are joined for the few fused hits.
    """
    chunks = chunks.where(F.col("vector").isNotNull())
    spark, size = chunks.sparkSession, fusion.fetch_size(k, folder)
    terms = bm25.question_terms(spark, question)
    statistics = statistics or bm25.Statistics.of(chunks)
    hits = postings if postings is not None else bm25.matches(chunks, question)
    keyword = bm25.ranked(bm25.scores(hits, statistics, terms), size)
    nearest = vector.search(chunks, query, size)
    rooted = "root" in chunks.columns
    paths = chunks.select("index_id", "row_id", "file", *(["root"] if rooted else []))
    fused = F.broadcast(fusion.fuse(nearest, keyword))  # at most twice the fetch size
    hits = paths.join(fused, ["index_id", "row_id"])
    root = F.col("root") if rooted else None
    shown = relative_path(F.col("file"), root) if rooted else F.col("file")
    hits = fusion.weighted(hits, shown, wants_tests(F.lit(question)))
    top = fusion.head(hits, k, in_folder(F.col("file"), root, folder) if folder else None)
    return top.select("rank", "index_id", "row_id", "file", "fused")


def results(top: DataFrame, chunks: DataFrame) -> DataFrame:
    """rank, source, text, start_line, end_line, loc: what a user sees; scores stay inside."""
    text = chunks.select("index_id", "row_id", "text", "start_line", "end_line")
    shown = text.join(F.broadcast(top), ["index_id", "row_id"])  # k rows
    where = location(F.col("file"), F.col("start_line"), F.col("end_line"))
    return shown.select("rank", F.col("file").alias("source"), "text", "start_line", "end_line", where.alias("loc")).orderBy("rank")
