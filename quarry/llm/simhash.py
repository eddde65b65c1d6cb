"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 4 bits differ in at most 4 of their 8 bytes, so
at least 4 positional bytes are equal: the guaranteed minimum. The index has a posting list
for each way to reach that minimum, four positions with their values, so a pair meets in a
list exactly when its tally of shared positional bytes reaches 4. A pair that shares more
would meet again and again; it counts only in the list of its first four shared positions.
There it is verified by its differing bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, materialize
from .components import components

SHINGLE, SEED, BITS, BYTES = 4, 42, 4, 8
LEAST = BYTES - BITS
#: Posting lists up to this length are compared pair by pair; longer ones go by neighbourhoods.
LONG_LIST = 4096
BROADCAST_ROWS = 500_000
#: Fingerprints whose postings one task makes, and shares in which a large component learns its smallest id.
TASK_PRINTS, SHARES = 16_384, 32

PLACES = list(combinations(range(BYTES), LEAST))
#: For each set of shared positions, as a bit mask: how many they are, and the posting list of the
#: first LEAST of them, in which such a pair counts (-1: they are fewer).
TALLY = np.array([mask.bit_count() for mask in range(256)])
FIRST_LIST = np.array([PLACES.index(tuple(b for b in range(BYTES) if mask >> b & 1)[:LEAST]) if TALLY[mask] >= LEAST else -1 for mask in range(256)])
LOW_BITS = np.uint64(0x0101010101010101)


def shingle_hashes(raw: bytes) -> list[int]:
    words = raw.lower().split()  # of bytes: A-Z only, and white space of ASCII only
    if not words:
        return []
    if len(words) <= SHINGLE:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    text, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(len(w) + 1 for w in words))
    return [digest(text[a : b - 1], SEED) for a, b in zip([0, *ends], ends[SHINGLE - 1 :], strict=False)]


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """Unsigned fingerprints; bits are counted eight at a time in the bytes of a word, 255 rows at most."""
    hashes = [shingle_hashes(t) for t in texts]
    counts = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(texts), np.uint64)
    if not counts.sum():
        return out
    flat = np.array([h for own in hashes for h in own], np.uint64)
    full = np.flatnonzero(counts)
    first = (np.cumsum(counts) - counts)[full]
    parts = -(-counts[full] // 255)
    part_first = np.cumsum(parts) - parts
    starts = np.repeat(first - 255 * part_first, parts) + 255 * np.arange(parts.sum())
    for bit in range(8):
        lanes = np.add.reduceat(flat >> np.uint64(bit) & LOW_BITS, starts).view(np.uint8).reshape(-1, 8)
        sums = np.add.reduceat(lanes.astype(np.int64), part_first, axis=0)
        majority = (2 * sums > counts[full, None]).astype(np.uint64)
        out[full] |= (majority << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(bit))).sum(axis=1, dtype=np.uint64)
    return out


@F.pandas_udf(T.LongType())
def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Fingerprint of a text as a signed long (null: that of an empty text, zero)."""
    for texts in batches:
        found = [fingerprints(part) for part in chunks(texts)]
        yield pd.Series(np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64))


def list_keys(fp: Column) -> Column:
    """The posting lists of a fingerprint: which four positions, and their bytes."""
    byte = [F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255).cast("long")) for p in range(BYTES)]
    keys = []
    for n, places in enumerate(PLACES):
        key = F.lit(n).cast("long")
        for p in places:
            key = F.shiftleft(key, 8).bitwiseOR(byte[p])
        keys.append(key)
    return F.array(*keys)


def forest(posting_list: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what this list's pairs join: every member with the smallest it reaches."""
    prints = np.sort(prints.view(np.uint64))
    label = np.arange(len(prints))
    ours, theirs = [], []
    for at in range(0, len(prints), 512):
        differ = prints[at : at + 512, None] ^ prints[None, :]
        a, b = np.nonzero(np.bitwise_count(differ) <= BITS)
        a, b, differ = a + at, b, differ[a, b]
        shared = sum(((differ >> np.uint64(8 * p) & np.uint64(255)) == 0).astype(np.int64) << p for p in range(BYTES))
        keep = (a < b) & (TALLY[shared] >= LEAST) & (FIRST_LIST[shared] == posting_list)
        ours.append(a[keep])
        theirs.append(b[keep])
    a, b = np.concatenate(ours), np.concatenate(theirs)
    while True:
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label[a] == label[b]).all():
            break
    child = np.flatnonzero(label != np.arange(len(label)))
    return prints[child].view(np.int64), prints[label[child]].view(np.int64)


def _short_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        u, v = [], []
        for key, members in zip(batch["key"], batch["fps"], strict=True):
            if len(members) == 2:
                differ = (int(members[0]) ^ int(members[1])) & (1 << 64) - 1
                if differ.bit_count() <= BITS:
                    shared = sum((differ >> 8 * p & 255 == 0) << p for p in range(BYTES))
                    if FIRST_LIST[shared] == key >> 32:
                        u.append(int(members[0]))
                        v.append(int(members[1]))
            else:
                a, b = forest(key >> 32, np.asarray(members, np.int64))
                u += a.tolist()
                v += b.tolist()
        yield pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})


def _long_lists(rows: DataFrame) -> DataFrame:
    """Edges of lists of any length. Members of a list agree in four bytes; two of them are linked
    exactly if some value of the other four is within 2 bits of both. Around such a value there
    are at most 529 members, so these groups are bounded and the rows grow with the list."""
    half = BITS // 2
    free = [[8 * p + b for p in range(BYTES) if p not in places for b in range(8)] for places in PLACES]
    masks = [[sum(1 << b for b in bits) for k in range(half + 1) for bits in combinations(own, k)] for own in free]
    signed = [[m - (1 << 64) if m >> 63 else m for m in own] for own in masks]
    table = rows.sparkSession.createDataFrame([(n, own) for n, own in enumerate(signed)], "place int, masks array<long>")
    near = rows.join(F.broadcast(table), F.shiftright("key", 32) == F.col("place")).select(
        "key", "fp", F.explode(F.transform("masks", lambda m: F.col("fp").bitwiseXOR(m))).alias("around")
    )
    members = near.groupBy("key", "around").agg(F.min("fp").alias("low"), F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return members.select(F.explode("fps").alias("u"), F.col("low").alias("v")).where(F.col("u") != F.col("v")).distinct()


def links(prints: DataFrame, long_list: int = LONG_LIST) -> DataFrame:
    """Edges u, v between distinct fingerprints ``fp`` whose components are those of all pairs
    that differ in at most BITS bits. Never more edges than members from one posting list."""
    tasks = -(-prints.count() // TASK_PRINTS) or 1
    postings = prints.select("fp").repartition(int(tasks), "fp").select("fp", F.explode(list_keys(F.col("fp"))).alias("key"))
    lists = materialize(postings.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1), "lists")
    few = lists.count() <= BROADCAST_ROWS
    rows = postings.join(F.broadcast(lists) if few else lists, "key")
    short = rows.where(F.col("n") <= long_list).groupBy("key").agg(F.collect_list("fp").alias("fps")).mapInPandas(_short_lists, "u long, v long")
    if lists.where(F.col("n") > long_list).limit(1).count() == 0:
        return short
    return short.unionByName(_long_lists(rows.where(F.col("n") > long_list).select("key", "fp")))


def _row_key(docs: DataFrame) -> Column:
    """Tells rows that share an id apart by their texts."""
    return F.xxhash64(docs["text"], docs["doc_id"])


def _grouped(docs: DataFrame, long_list: int) -> DataFrame:
    """doc_id, key, fp, component_id, root of every row."""
    marked = materialize(docs.select("doc_id", _row_key(docs).alias("key"), fingerprint(F.col("text")).alias("fp")), "fingerprints")
    groups = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "groups")
    roots = materialize(components(links(groups, long_list)), "roots")
    # only prints with links have others to ask; a component's rows learn its smallest id in shares
    share = F.pmod(F.xxhash64("fp"), F.lit(SHARES))
    linked = groups.join(roots, groups["fp"] == roots["node"]).select("fp", "low", "root", share.alias("share"))
    lowest = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    told = lowest.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))))
    joined = linked.join(told, ["root", "share"]).select("fp", "component_id", "root")
    alone = groups.join(roots, groups["fp"] == roots["node"], "left_anti").select("fp", F.col("low").alias("component_id"), F.col("fp").alias("root"))
    by_print = joined.unionByName(alone).withColumnRenamed("fp", "own")
    return marked.join(by_print, marked["fp"] == F.col("own"), "left").drop("own")


def near_duplicates(docs: DataFrame, long_list: int = LONG_LIST) -> DataFrame:
    """doc_id, fingerprint, component_id, root of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id among all documents reachable over links, itself
    included; root is the component's smallest fingerprint as a signed number. Null ids never
    are the smallest, and a component of null ids has a null component_id. A null text is
    empty; texts without words have fingerprint zero and are linked like any others. Copies
    share a fingerprint and are summed up before the index is built, so a group of copies is
    one entry of it, and repeated rows change nothing. An empty table gives an empty table;
    other columns are not read.
    """
    return _grouped(docs, long_list).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest id, all columns kept.

    Rows are judged by their own texts, also where they share an id: a row goes if another of
    its component has a smaller id, or the same id and comes first by a hash of its text; of
    rows with the same id and text one stays. So unrelated texts of one id all stay. A document
    without an id goes if its component has one with an id; of others without an id, one row
    of each component stays. Null and empty texts are one component.
    """
    found = materialize(_grouped(docs.select("doc_id", "text"), LONG_LIST), "grouped")
    again = found.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id", "root").agg(F.min("key").alias("first"), F.count("*").alias("n"))
    again = materialize(again.where(F.col("n") > 1).select("doc_id", "root", "first"), "again")
    later = found.join(again, ["doc_id", "root"]).where(F.col("key") != F.col("first")).select("doc_id", "key")
    gone = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id", "key").unionByName(later).distinct()
    gone = materialize(gone.withColumnsRenamed({"doc_id": "gone_doc", "key": "gone_key"}), "copies")
    few = gone.count() <= BROADCAST_ROWS
    same = (docs["doc_id"] == gone["gone_doc"]) & (_row_key(docs) == gone["gone_key"])
    kept = docs.where(F.col("doc_id").isNotNull()).join(F.broadcast(gone) if few else gone, same, "left_anti")
    if again.limit(1).count():
        ids = again.select("doc_id").distinct()
        kept = kept.join(ids, "doc_id", "left_anti").select(docs.columns).unionByName(kept.join(ids, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"]))
    nameless = docs.where(F.col("doc_id").isNull())
    if nameless.limit(1).count():
        alone = found.where(F.col("doc_id").isNull() & F.col("component_id").isNull()).groupBy("root").agg(F.min("fp").alias("mark"))
        rows = nameless.select(fingerprint(F.col("text")).alias("mark"), F.struct(*docs.columns).alias("row")).join(alone, "mark", "left_semi")
        kept = kept.select(docs.columns).unionByName(rows.dropDuplicates(["mark"]).select("row.*"))
    return kept.select(docs.columns)
