"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _hang(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with the smallest neighbour of u or u itself.

    The minimum is summed up before the shuffle; the join back to the edges is one that
    adaptive execution splits where u is a hub.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("hub"), F.least("u", "low").alias("low"))
    return edges.join(least, F.col("u") == F.col("hub")).select("u", "v", "low")


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """node, root: the smallest node of its component, for every node that has an edge to another.

    ``edges`` has longs u and v in any direction, repeats and loops allowed. A large-star and a
    small-star step alternate until nothing moves, which takes a number of rounds that is
    logarithmic in the longest path; each round is written to shared storage.
    """
    edges = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = materialize(edges, "edges"), None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hang(both).where((F.col("v") > F.col("u")) & (F.col("v") != F.col("low"))).select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        hung = _hang(large)
        small = hung.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(hung.select("u", F.col("low").alias("v")))
        edges = materialize(small.where(F.col("u") != F.col("v")).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if now == before:
            return edges.unionByName(edges.select(F.col("v").alias("u"), "v").distinct()).select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
