"""Reciprocal rank fusion of ranked lists, and what follows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TEST_PENALTY, is_test_code

# The constant of the fusion, and how many hits of each list are taken for k results.
RRF, OVERFETCH, FOLDER_FACTOR = 60, 3, 2


def fetch_size(k: int, folder: str | None = None) -> int:
    if k <= 0:
        raise ValueError("k must be positive")
    return OVERFETCH * k * (FOLDER_FACTOR if folder else 1)


def fuse(nearest: DataFrame, keyword: DataFrame) -> DataFrame:
    """index_id, row_id, fused, vector_rank, keyword_rank of the union of two ranked lists.

    A union with one aggregation rather than a full outer join: both lists are short, and
    partial sums meet in one shuffle.
    """
    both = nearest.select("index_id", "row_id", F.col("rank").alias("vector_rank"), F.lit(None).cast("int").alias("keyword_rank")).unionByName(
        keyword.select("index_id", "row_id", F.lit(None).cast("int").alias("vector_rank"), F.col("rank").alias("keyword_rank"))
    )
    part = F.lit(1.0) / (F.lit(RRF) + F.coalesce("vector_rank", "keyword_rank"))
    return both.groupBy("index_id", "row_id").agg(F.sum(part).alias("fused"), F.max("vector_rank").alias("vector_rank"), F.max("keyword_rank").alias("keyword_rank"))


def order_of_hits() -> list[Column]:
    """Equal scores: hits of the vector list first, by rank, then those of keywords alone."""
    return [F.desc("fused"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("keyword_rank"), F.asc("index_id"), F.asc("row_id")]


def weighted(fused: DataFrame, path: Column, asks_for_tests: Column) -> DataFrame:
    """Halve the score of test code, unless the question asks for tests."""
    factor = F.when(is_test_code(path) & ~asks_for_tests, F.lit(TEST_PENALTY)).otherwise(F.lit(1.0))
    return fused.withColumn("fused", F.round(F.col("fused") * factor, 12))


def head(fused: DataFrame, k: int, folder: Column | None = None) -> DataFrame:
    """The first k in order, after the folder's filter, numbered from 1."""
    if folder is not None:
        fused = fused.where(folder)
    return fused.orderBy(*order_of_hits()).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order_of_hits())))
