"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every run of WINDOW words holds WINDOW - GRAM + 1 hashes of GRAM words. Documents and items
both keep the smallest of each run, so whatever run they share, they share a kept hash. The
kept hashes are joined; a document's hits are extended to all runs around them, and those are
compared with the items' runs as text, which makes the result exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

WINDOW, GRAM = 8, 4
#: Rows, and bytes of text, up to which a side is broadcast after they were counted; beyond it both sides are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NO_ITEMS = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # sha256 of no text


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased. ``lower``, which is faster, does the same to ASCII
    alone; elsewhere it changes other letters too, a capital sigma by what stands beside it."""
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), SEPARATORS), "")


def _steps(n: Column) -> Column:
    """0 .. n - 1; empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def grams(w: Column, n: int) -> Column:
    """Hash of each run of ``n`` words."""
    return F.transform(_steps(F.size(w) - (n - 1)), lambda i: F.xxhash64(F.lit(n), *[F.get(w, i + j) for j in range(n)]))


def winnowed(hashes: Column) -> Column:
    """The smallest hash of each run of WINDOW words, once each."""
    run = WINDOW - GRAM + 1
    return F.array_distinct(F.transform(_steps(F.size(hashes) - (run - 1)), lambda i: F.least(*[F.get(hashes, i + j) for j in range(run)])))


def runs(w: Column, n: int) -> Column:
    """All runs of ``n`` words, space-joined."""
    return F.transform(_steps(F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i + 1, n), " "))


def _sized(df: DataFrame, rows: int, size: int = 0) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns of ``contamination``, with a key of the row's id and text."""
    item = benchmark.where(F.col("item_id").isNotNull()).select("item_id", words(F.col("text")).alias("w"))
    item = materialize(item.where(F.size("w") > 0), "items")
    short = sorted(r[0] for r in item.where(F.size("w") < WINDOW).select(F.size("w")).distinct().collect())  # at most WINDOW - 1 lengths
    lengths = [*short, WINDOW]

    targets = materialize(
        item.select("item_id", F.explode(F.when(F.size("w") < WINDOW, F.array(F.array_join("w", " "))).otherwise(runs(F.col("w"), WINDOW))).alias("run")).distinct(),
        "runs",
    )
    marks = materialize(
        item.select(
            F.explode(
                F.when(F.size("w") >= WINDOW, winnowed(grams(F.col("w"), GRAM))).otherwise(
                    F.flatten(F.array(F.array().cast("array<bigint>"), *[F.when(F.size("w") == n, grams(F.col("w"), n)).otherwise(F.array().cast("array<bigint>")) for n in short]))
                )
            ).alias("mark")
        ).distinct(),
        "marks",
    )
    n_targets, target_bytes = targets.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("run")), F.lit(0))).collect()[0]
    n_marks = marks.count()

    base = docs.select("doc_id", "text", F.xxhash64("text", "doc_id").alias("key"))
    cut = base.select("doc_id", "key", words(F.col("text")).alias("w"))
    kept = cut.select("doc_id", "key", "w", grams(F.col("w"), GRAM).alias("g")).select(
        "doc_id", "key", F.explode(F.array_distinct(F.concat(winnowed(F.col("g")), *[grams(F.col("w"), n) for n in short]))).alias("mark")
    )
    found = materialize(
        kept.join(_sized(marks, n_marks), "mark", "left_semi").groupBy("doc_id", "key").agg(F.collect_set("mark").alias("marks")), "hits"
    )

    one = found.select(F.col("doc_id").alias("hit_doc"), F.col("key").alias("hit_key"), "marks")
    joined = base.join(_sized(one, found.agg(F.coalesce(F.sum(F.size("marks")), F.lit(0))).collect()[0][0]), base["doc_id"].eqNullSafe(F.col("hit_doc")) & (base["key"] == F.col("hit_key")), "left")
    cut = joined.select("doc_id", "key", "marks", words(F.col("text")).alias("w"))

    def near(n: int) -> Column:
        """Starts of the runs of ``n`` words that hold a hit; a short item's run is its own hash."""
        size, reach = (GRAM, WINDOW - GRAM) if n == WINDOW else (n, 0)
        at = F.filter(_steps(F.size("w") - (size - 1)), lambda i: F.array_contains("marks", F.xxhash64(F.lit(size), *[F.get(F.col("w"), i + j) for j in range(size)])))
        starts = F.array_distinct(F.flatten(F.transform(at, lambda i: F.sequence(i - reach, i))))
        return F.transform(
            F.filter(starts, lambda s: (s >= 0) & (s + n <= F.size("w"))),
            lambda s: F.struct(s.alias("start"), F.lit(n).alias("length"), F.array_join(F.slice(F.col("w"), s + 1, n), " ").alias("run")),
        )

    extended = materialize(
        cut.select(
            "doc_id", "key", F.size("w").cast("long").alias("n_words"), F.when(F.col("marks").isNotNull(), F.concat(*map(near, lengths))).alias("near")
        ),
        "extended",
    )
    hits = extended.select("doc_id", "key", F.explode("near").alias("n")).select("doc_id", "key", "n.start", "n.length", "n.run")
    per_doc = (
        hits.join(_sized(targets, n_targets, target_bytes), "run")
        .groupBy("doc_id", "key")
        .agg(F.collect_set(F.struct("start", "length")).alias("spans"), F.collect_set("item_id").alias("items"))
    )
    # the words that spans, ordered by start, cover: each adds what lies beyond the end of those before
    nothing = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("covered"))

    def extend(done: Column, span: Column) -> Column:
        end = span["start"] + span["length"]
        beyond = F.greatest(F.lit(0), end - F.greatest(done["end"], span["start"]))
        return F.struct(F.greatest(done["end"], end).alias("end"), (done["covered"] + beyond).cast("long").alias("covered"))

    per_doc = per_doc.select(
        "doc_id",
        "key",
        F.aggregate(F.array_sort("spans"), nothing, extend, lambda done: done["covered"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",").cast("binary"), 256).alias("items_sha256"),
    )
    out = extended.select("doc_id", "key", "n_words").join(per_doc.withColumnsRenamed({"doc_id": "hit_doc", "key": "hit_key"}), F.col("doc_id").eqNullSafe(F.col("hit_doc")) & (F.col("key") == F.col("hit_key")), "left")
    n_items = F.coalesce("n_items", F.lit(0).cast("long"))
    return out.select(
        "doc_id",
        "key",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        n_items.alias("n_items"),
        F.coalesce("items_sha256", F.lit(NO_ITEMS)).alias("items_sha256"),
        (n_items >= 2).alias("contaminated"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of ``docs``.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; no other column is read. A
    null text has no words. Items without words or with a null item_id hit nothing, and rows
    of one item_id count as one item. Repeated rows of ``docs`` each get their row; rows that
    share a doc_id but not the text are judged apart. An empty table of either kind is no
    special case. Documents are handled as arrays of words, so a very long one is one row of
    one task; no group of several documents is ever gathered.
    """
    return judged(docs, benchmark).drop("key")


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, least: int = 2) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hit fewer than ``least`` items.

    Two is what the column ``contaminated`` says; with one, no run of any item is left. Each
    row is judged by its own text, also where rows share an id or have none.
    """
    bad = judged(docs.select("doc_id", "text"), benchmark).where(F.col("n_items") >= least).select(F.col("doc_id").alias("bad_doc"), F.col("key").alias("bad_key")).distinct()
    bad = materialize(bad, "contaminated")
    same = docs["doc_id"].eqNullSafe(bad["bad_doc"]) & (F.xxhash64(docs["text"], docs["doc_id"]) == bad["bad_key"])
    return docs.join(_sized(bad, bad.count()), same, "left_anti")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), runs AS (
  SELECT DISTINCT item_id, len(w) AS n, array_to_string(w, ' ') AS run FROM b WHERE len(w) BETWEEN 1 AND 7
  UNION
  SELECT DISTINCT item_id, 8, array_to_string(w[i:i + 7], ' ') FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM b WHERE len(w) >= 8)
), lengths AS (SELECT DISTINCT n FROM runs),
places AS (
  SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n
), hits AS (
  SELECT doc_id, i, p.n, item_id FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS run FROM places) p JOIN runs USING (run)
), covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
