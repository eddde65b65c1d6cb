"""Exact nearest vectors by dot product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bm25 import DIGITS, ranked


def dot(a: Column, b: Column) -> Column:
    """In double precision, in the JVM."""
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def similarity(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """index_id, row_id, score (rounded) of all vectors with the one row of ``query`` (column query)."""
    return vectors.crossJoin(F.broadcast(query)).select("index_id", "row_id", F.round(dot(F.col("vector"), F.col("query")), DIGITS).alias("score"))


def search(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """The k nearest: index_id, row_id, score, rank. There is no threshold."""
    return ranked(similarity(vectors, query), k)


def search_per_index(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """The k nearest of each index; groups are cut before and after the shuffle."""
    order = Window.partitionBy("index_id").orderBy(F.desc("score"), F.asc("row_id"))
    return similarity(vectors, query).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
