"""Nearest neighbours by vantage-point trees, one for each shard of the vectors.

A tree's node has a vantage point; its two halves are the points nearer to it and those
further off, with the range of their distances. By the triangle inequality a half can hold
nothing nearer than what its range and the query's own distance leave open. A half is skipped
if that bound is beyond ``factor`` times the distance of the tenth neighbour so far: with
factor one nothing is lost, with less the search is approximate and visits fewer points.

Shards are regions: the upper nodes of one tree, built on a bounded sample, deal the vectors. A
query is searched in its own region first, and then sent only to regions whose bound its tenth
distance leaves open, by the same rule. How much of the bound a search can do without depends
on the vectors, so the factor is the least with which the sample's own search finds enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Vectors in a shard and queries in a block, about: together they bound a task's memory.
SHARD, BLOCK = 4096, 4096
LEAF = 64
NEAREST = 10
#: Vectors in the sample, and in each region of it at least.
SAMPLE, REGION = 8192, 8
#: Factors that are tried in turn on some queries among so many of the sample, and the share of neighbours that must be found.
FACTORS, TRIED, AMONG, FOUND = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9), 128, 4096, 0.98
#: Rows up to which a side is broadcast after its rows were counted.
BROADCAST_ROWS = 500_000

RESULT = "query_id long, vec_id long, score double"


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, in double precision, from the differences themselves."""
    out = np.empty((len(a), len(b)))
    for i in range(0, len(a), 256):
        out[i : i + 256] = np.sqrt(((a[i : i + 256, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    return out


@dataclass
class Node:
    points: np.ndarray  # of a leaf: its points; else the vantage point alone
    halves: tuple = ()  # (node, smallest distance, largest distance)


class Tree:
    def __init__(self, vectors: np.ndarray, ids: np.ndarray, seed: int = 9):
        self.vectors, self.ids = vectors, ids
        self.draw = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(ids)))

    def _build(self, points: np.ndarray) -> Node:
        if len(points) <= LEAF:
            return Node(points)
        at = int(self.draw.integers(len(points)))
        rest = np.delete(points, at)
        far = distances(self.vectors[points[at : at + 1]], self.vectors[rest])[0]
        order = np.argsort(far, kind="stable")  # halves by rank: equal distances can't make one empty
        cut = len(order) // 2
        return Node(points[at : at + 1], tuple((self._build(rest[part]), far[part[0]], far[part[-1]]) for part in (order[:cut], order[cut:])))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids of the k nearest of each query, nearest first; infinity where there are
        fewer. ``within`` is a distance that k others are known to have, so none beyond is needed."""
        self.q, self.own, self.factor, self.visited = queries, own, factor, 0
        self.within = np.full(len(queries), np.inf) if within is None else within
        self.best = np.full((len(queries), k), np.inf)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        self._visit(self.root, np.arange(len(queries)))
        return self.best, self.found

    def _visit(self, node: Node, active: np.ndarray) -> None:
        if not len(active) or not len(node.points):
            return
        far = distances(self.q[active], self.vectors[node.points])
        self.visited += far.size
        self._offer(active, far, self.ids[node.points])
        if not node.halves:
            return
        far = far[:, 0]
        bounds = [np.maximum(0, np.maximum(low - far, far - high)) for _, low, high in node.halves]
        inner = bounds[0] <= bounds[1]
        for first, group in ((0, inner), (1, ~inner)):
            for half in (first, 1 - first):
                open_ = group & (bounds[half] <= self.factor * np.minimum(self.best[active, -1], self.within[active]))
                self._visit(node.halves[half][0], active[open_])

    def _offer(self, active: np.ndarray, far: np.ndarray, ids: np.ndarray) -> None:
        far = np.where(ids[None, :] == self.own[active][:, None], np.inf, far)
        some = (far <= np.minimum(self.best[active, -1:], self.within[active][:, None])).any(axis=1)
        active, far = active[some], far[some]
        if not len(active):
            return
        every = np.concatenate([self.best[active], far], axis=1)
        names = np.concatenate([self.found[active], np.broadcast_to(ids, far.shape)], axis=1)
        order = np.lexsort((names, every), axis=-1)[:, : self.best.shape[1]]
        self.best[active] = np.take_along_axis(every, order, axis=1)
        self.found[active] = np.take_along_axis(names, order, axis=1)


class Regions:
    """The upper nodes of a tree over a sample: a vantage point and a radius each."""

    def __init__(self, sample: np.ndarray, most: int, seed: int = 8):
        self.draw, self.most = np.random.default_rng(seed), most
        self.root, self.count = None, 0
        self.root = self._build(sample, 1)

    def _build(self, points: np.ndarray, siblings: int) -> tuple | int:
        """(vantage point, radius, inner, outer), or the number of a region; ``siblings`` nodes are as deep."""
        if siblings < self.most and len(points) >= 2 * REGION:
            vantage = points[int(self.draw.integers(len(points)))]
            far = distances(vantage[None], points)[0]
            radius = float(np.median(far))
            inside = far <= radius
            if not inside.all():
                return vantage, radius, self._build(points[inside], 2 * siblings), self._build(points[~inside], 2 * siblings)
        self.count += 1
        return self.count - 1

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """The region of each vector."""
        out = np.zeros(len(vectors), np.int32)

        def walk(node: tuple | int, some: np.ndarray) -> None:
            if isinstance(node, int):
                out[some] = node
            elif len(some):
                vantage, radius, inner, outer = node
                inside = distances(vectors[some], vantage[None])[:, 0] <= radius
                walk(inner, some[inside])
                walk(outer, some[~inside])

        walk(self.root, np.arange(len(vectors)))
        return out

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """How far each region is from each query at least."""
        out = np.zeros((len(queries), self.count))

        def walk(node: tuple | int, least: np.ndarray) -> None:
            if isinstance(node, int):
                out[:, node] = least
                return
            vantage, radius, inner, outer = node
            far = distances(queries, vantage[None])[:, 0]
            walk(inner, np.maximum(least, far - radius))
            walk(outer, np.maximum(least, radius - far))

        walk(self.root, np.zeros(len(queries)))
        return out


def fitting_factor(sample: np.ndarray, k: int) -> float:
    """The least of FACTORS with which a search among the sample finds enough of its nearest; else 1."""
    sample = sample[np.random.default_rng(7).permutation(len(sample))[:AMONG]]  # sorted before
    tree, some = Tree(sample, np.arange(len(sample))), np.arange(0, len(sample), max(1, len(sample) // TRIED))
    best = tree.search(sample[some], some, k, 1.0)[0]
    real = np.isfinite(best)
    for factor in FACTORS if real.any() else ():
        got = tree.search(sample[some], some, k, factor)[0]
        if (got[real] <= best[real]).mean() >= FOUND:
            return factor
    return 1.0


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def searcher(k: int, factors: dict[int, float]):
    def run(key: tuple, shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(block):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        shard, block = shard.sort_values("vec_id"), block.sort_values("query_id")
        tree = Tree(_matrix(shard["embedding"]), shard["vec_id"].to_numpy(np.int64))
        own = block["query_id"].to_numpy(np.int64)
        best, found = tree.search(_matrix(block["embedding"]), own, k, factors.get(int(key[0]), 1.0), block["within"].to_numpy(float))
        real = np.isfinite(best)
        return pd.DataFrame({"query_id": np.repeat(own, k)[real.ravel()], "vec_id": found[real], "score": best[real]})

    return run


def usable(vector: Column) -> Column:
    """Not null, not zero, and of finite components only."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(whole & F.exists(vector, lambda x: x != 0), F.lit(False))


PLACE = ["size", "region", "part", "block"]


def nearest(vectors: DataFrame, is_query: Column, k: int = NEAREST, factor: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: of each row for which ``is_query`` (of vec_id) holds its k
    nearest others found, nearest first, ties to the smaller vec_id; all there are if fewer.

    ``vectors`` has vec_id and embedding; no other column is read. Rows without a vec_id, and
    vectors that are null, zero, or have a null or non-finite component, take no part, neither
    as queries nor as candidates; nor do vectors of another length than the query's. Of rows
    that repeat a vec_id, that with the smallest vector counts. Of equal vectors only the k + 1
    smallest ids are candidates, as no query needs more, so a vector that most rows have fills
    no region. Without ``factor`` it is fitted to a sample of SAMPLE vectors, the first by a
    hash of vec_id; one is exact. A region beyond SHARD vectors is split by a hash into parts
    that a query meets one by one, and queries of a region come in blocks.
    """
    spark = vectors.sparkSession
    some = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    if some.groupBy("vec_id").count().where(F.col("count") > 1).limit(1).count():
        some = some.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    some = some.withColumn("size", F.size("embedding"))
    asked = some.where(is_query).withColumnRenamed("vec_id", "query_id")
    # equal vectors are known by 128 bits; where there are more than k + 1, the largest id that counts
    marks = [F.xxhash64("embedding").alias("mark"), F.xxhash64(F.lit(1), "embedding").alias("mark2")]
    copy = F.row_number().over(Window.partitionBy("mark", "mark2").orderBy("vec_id"))  # a group limit cuts it before the shuffle
    copies = some.select(*marks, "vec_id").withColumn("copy", copy).where(F.col("copy") <= k + 1)
    last = copies.groupBy("mark", "mark2").agg(F.count("*").alias("copies"), F.max("vec_id").alias("last")).where(F.col("copies") > k).drop("copies")
    last = materialize(last, "copies")
    points, many = some, last.count()
    if many:
        points = some.select("*", *marks).join(F.broadcast(last) if many <= BROADCAST_ROWS else last, ["mark", "mark2"], "left")
        points = points.where(F.col("last").isNull() | (F.col("vec_id") <= F.col("last")))

    sample: dict[int, list] = {}
    for row in some.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect():
        sample.setdefault(row["size"], []).append(row["embedding"])
    sample = {size: np.unique(np.array(rows, float), axis=0) for size, rows in sample.items()}
    total = some.count()
    regions = {size: Regions(rows, -(-total // SHARD)) for size, rows in sample.items()}
    factors = {size: fitting_factor(rows, k) if factor is None else factor for size, rows in sample.items()}
    held = spark.sparkContext.broadcast((regions, factors))  # at most SAMPLE vectors

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["region"] = np.int32(0)  # that of lengths which the sample has none of
            for size, own in batch.groupby("size"):
                if int(size) in held.value[0]:
                    batch.loc[own.index, "region"] = held.value[0][int(size)].of(_matrix(own["embedding"]))
            yield batch

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query once for each region that its k-th distance so far leaves open, but for its own."""
        for batch in batches:
            for size, own in batch.groupby("size"):
                if int(size) not in held.value[0]:
                    continue
                bounds = held.value[0][int(size)].bounds(_matrix(own["embedding"]))
                left = bounds <= held.value[1][int(size)] * own["within"].to_numpy(float)[:, None]
                left[np.arange(len(own)), own["region"].to_numpy()] = False
                at, region = np.nonzero(left)
                yield own.iloc[at].assign(region=region.astype(np.int32))

    kind = some.schema["embedding"].dataType.simpleString()
    layout = f"embedding {kind}, size int, region int"
    points = materialize(points.select("vec_id", "embedding", "size").mapInPandas(dealt, f"vec_id long, {layout}"), "points")
    home = asked.select("query_id", "embedding", "size").mapInPandas(dealt, f"query_id long, {layout}")
    home = materialize(home.withColumn("within", F.lit(float("inf"))), "home")
    parts = points.groupBy("size", "region").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("parts"))
    parts = materialize(parts, "parts")  # a row a region

    def searched(visits: DataFrame) -> DataFrame:
        """What is found in the regions that queries visit."""
        plan = parts.join(visits.groupBy("size", "region").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), ["size", "region"])
        plan = F.broadcast(materialize(plan, "plan"))  # a row a region
        one = points.join(plan, ["size", "region"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
        one = one.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("vec_id", "embedding", *PLACE)
        two = visits.join(plan, ["size", "region"]).withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(1)), F.col("blocks")).cast("int"))
        two = two.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("query_id", "embedding", "within", *PLACE)
        return materialize(one.groupBy(*PLACE).cogroup(two.groupBy(*PLACE)).applyInPandas(searcher(k, factors), RESULT), "found")

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    near = searched(home)
    # the k-th distance at home; without as many there, none is known
    kth = near.withColumn("rank", rank).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    known = home.drop("within").join(kth, "query_id", "left").withColumn("within", F.coalesce("kth", F.lit(float("inf")))).drop("kth")
    visits = materialize(known.mapInPandas(routed, f"query_id long, {layout}, within double"), "visits")
    found = near.unionByName(searched(visits))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
