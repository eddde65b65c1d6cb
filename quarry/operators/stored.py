"""Stored indexes: tokenized once into tables that questions read.

``postings`` lie in segments, files of some chunks' words each, sorted by term, and carry their
chunk's length; ``frequencies`` are sorted by term; ``sizes`` has a row an index, with the sum of
its own words' raw weights, so that no question reads the whole vocabulary. A question's words
reach the scans as literals, which skips the pages of a segment that hold others. Its weights
are a few numbers and go into the plan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import relative_path, wants_tests
from . import bm25, fusion, vector
from .search import in_folder

#: By which columns the files of a table are sorted.
SORTED = {"postings": ["term"], "frequencies": ["term"], "chunks": ["row_id"]}
#: Bytes of text a segment of postings is made of; small collections have a segment a core, of SMALL bytes at least.
SEGMENT, SMALL = 1 << 24, 1 << 20


def segments(chunks: DataFrame) -> int:
    size = chunks.agg(F.sum(F.octet_length("text").cast("long"))).collect()[0][0] or 0
    return max(1, -(-size // SEGMENT), min(chunks.sparkSession.sparkContext.defaultParallelism, -(-size // SMALL)))


def postings(chunks: DataFrame) -> DataFrame:
    """index_id, row_id, length, term, tf.

    Texts are shuffled rather than their words, which are several times as large: all words of a
    row meet where its text is. The number of tasks follows the bytes of text, so that counting
    and sorting a task's words needs the same memory whatever the input.
    """
    dealt = chunks.select("index_id", "row_id", "text").repartition(segments(chunks), "index_id", "row_id")
    # outer, as else the planner asks before the shuffle which rows have words, which tokenizes all texts once more
    words = bm25.tokenized(dealt).select("index_id", "row_id", F.size("terms").cast("long").alias("length"), F.explode_outer("terms").alias("term"))
    return words.where(F.col("term").isNotNull()).groupBy("index_id", "row_id", "length", "term").agg(F.count("*").alias("tf"))


def frequencies(postings: DataFrame) -> DataFrame:
    """index_id, term, df."""
    return postings.groupBy("index_id", "term").agg(F.count("*").alias("df"))


def sizes(chunks: DataFrame, postings: DataFrame, frequencies: DataFrame) -> DataFrame:
    """index_id, n, total_length, terms, idf_sum: chunks and words, and the words' raw weights by the index's own size.

    Lengths are summed over the postings, so that no text is tokenized again.
    """
    parts = chunks.select("index_id", F.lit(1).alias("n"), F.lit(0).cast("long").alias("tf")).unionByName(postings.select("index_id", F.lit(0).alias("n"), "tf"))
    own = parts.groupBy("index_id").agg(F.sum("n").alias("n"), F.sum("tf").alias("total_length"))
    weight = bm25.raw_idf(F.col("n"), F.col("df"))
    words = frequencies.join(F.broadcast(own.select("index_id", "n")), "index_id").groupBy("index_id").agg(F.count("*").alias("terms"), F.sum(weight).alias("idf_sum"))
    return own.join(words, "index_id", "left").fillna({"terms": 0, "idf_sum": 0.0})


@dataclass
class Weights:
    """What a question's words weigh, times how often they are asked for, and the mean length."""

    by_word: dict[str, float]
    mean_length: float


@dataclass
class StoredIndexes:
    """Tables of any number of indexes, searched as one collection; chunks have index_id, row_id and file."""

    chunks: DataFrame
    postings: DataFrame
    frequencies: DataFrame
    sizes: DataFrame

    def only(self, *indexes: str) -> StoredIndexes:
        some = F.col("index_id").isin(*indexes)
        return StoredIndexes(self.chunks.where(some), self.postings.where(some), self.frequencies.where(some), self.sizes.where(some))

    def weights(self, question: str) -> Weights:
        """Two small questions to the tables: a row over all indexes, and a row a word."""
        asked = bm25.question_words(question)
        whole = self.sizes.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "total_length", "terms", "idf_sum")]).collect()[0]
        found = self.frequencies.where(F.col("term").isin(*asked)).groupBy("term").agg(F.sum("df").alias("df")).collect() if asked else []
        n, floor = whole["n"], bm25.EPSILON * whole["idf_sum"] / whole["terms"] if whole["terms"] else 0.0
        raw = {r["term"]: math.log(n - r["df"] + 0.5) - math.log(r["df"] + 0.5) for r in found}
        return Weights({w: asked[w] * (floor if idf < 0 else idf) for w, idf in raw.items()}, whole["total_length"] / n if n else 1.0)

    def keyword(self, question: str, k: int) -> DataFrame:
        """index_id, row_id, score, rank of the k best chunks by BM25."""
        weights = self.weights(question)
        hits = self.postings.where(F.col("term").isin(*weights.by_word))
        weight = F.create_map(*[F.lit(x) for pair in weights.by_word.items() for x in pair])[F.col("term")] if weights.by_word else F.lit(0.0)
        norm = F.lit(bm25.K1) * (F.lit(1 - bm25.B) + F.lit(bm25.B) * F.col("length") / F.lit(weights.mean_length or 1.0))
        part = weight * F.col("tf") * F.lit(bm25.K1 + 1) / (F.col("tf") + norm)
        scored = hits.groupBy("index_id", "row_id").agg(F.round(F.sum(part), bm25.DIGITS).alias("score"))
        return bm25.ranked(scored.where(F.col("score") > 0), k)

    def hybrid(self, query: DataFrame, question: str, k: int, folder: str | None = None) -> DataFrame:
        """rank, index_id, row_id, file, fused of the k best chunks, as ``search.hybrid`` gives them.

        The two lists have at most the fetch size each and are fused from memory; the paths of
        their chunks are read by row number.
        """
        size = fusion.fetch_size(k, folder)
        spark, columns = self.chunks.sparkSession, ["index_id", "row_id", "rank"]
        lists = [found.select(*columns).collect() for found in (vector.search(self.chunks, query, size), self.keyword(question, size))]
        near, word = (spark.createDataFrame([tuple(r) for r in rows], "index_id string, row_id long, rank int").coalesce(1) for rows in lists)
        fused = fusion.fuse(near, word).coalesce(1)
        hits = self._at({r["row_id"] for rows in lists for r in rows}).join(F.broadcast(fused), ["index_id", "row_id"])
        root = F.col("root") if "root" in self.chunks.columns else None
        shown = F.col("file") if root is None else relative_path(F.col("file"), root)
        hits = fusion.weighted(hits, shown, wants_tests(F.lit(question)))
        top = fusion.head(hits, k, in_folder(F.col("file"), root, folder) if folder else None)
        return top.select("rank", "index_id", "row_id", "file", "fused")

    def _at(self, rows: set[int], *more: Column | str) -> DataFrame:
        """Identities and paths of the chunks with some row numbers; more columns if asked for."""
        own = ["index_id", "row_id", "file", *(["root"] if "root" in self.chunks.columns else []), *more]
        return self.chunks.where(F.col("row_id").isin(*rows)).select(*own)

    def texts(self, top: DataFrame) -> DataFrame:
        """The chunks of a result of ``hybrid``, in full; read by row number."""
        rows = {r["row_id"] for r in top.select("row_id").collect()}
        return self.chunks.where(F.col("row_id").isin(*rows))
