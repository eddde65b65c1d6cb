"""BM25 over one or many indexes, scored as if they were one collection.

Chunks have index_id, row_id and text. Postings, lengths and term statistics are plain
aggregations, so they sum up before each shuffle; a search reads only its own terms' postings.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CAMEL, TOKEN, ident_tokens

# Saturation, length share, and the floor of negative weights as a share of the mean.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Digits of a score that order hits; logarithms differ between engines beyond them.
DIGITS = 9


def tokenized(chunks: DataFrame) -> DataFrame:
    return chunks.select("index_id", "row_id", ident_tokens(F.coalesce("text", F.lit(""))).alias("terms"))


def lengths(chunks: DataFrame) -> DataFrame:
    """index_id, row_id, length: the number of tokens, zero included."""
    return tokenized(chunks).select("index_id", "row_id", F.size("terms").cast("long").alias("length"))


def postings(chunks: DataFrame) -> DataFrame:
    """index_id, row_id, term, tf."""
    return tokenized(chunks).select("index_id", "row_id", F.explode("terms").alias("term")).groupBy("index_id", "row_id", "term").agg(F.count("*").alias("tf"))


def matches(chunks: DataFrame, question: str) -> DataFrame:
    """index_id, row_id, length, term, tf of a question's terms only. All of a row's counts come
    from the row itself, so this needs no shuffle, and rows without any term end here."""
    words = F.array(*map(F.lit, question_words(question))).cast("array<string>")
    counted = F.transform(words, lambda w: F.struct(w.alias("term"), F.size(F.filter("terms", lambda t: t == w)).cast("long").alias("tf")))
    rows = tokenized(chunks).select("index_id", "row_id", F.size("terms").cast("long").alias("length"), F.explode(counted).alias("hit"))
    return rows.where(F.col("hit.tf") > 0).select("index_id", "row_id", "length", "hit.term", "hit.tf")


def document_frequency(chunks: DataFrame) -> DataFrame:
    """index_id, term, df: chunks that hold the term."""
    return tokenized(chunks).select("index_id", F.explode(F.array_distinct("terms")).alias("term")).groupBy("index_id", "term").agg(F.count("*").alias("df"))


def index_sizes(chunks: DataFrame) -> DataFrame:
    """index_id, n, total_length."""
    return lengths(chunks).groupBy("index_id").agg(F.count("*").alias("n"), F.sum("length").alias("total_length"))


def raw_idf(n: Column, df: Column) -> Column:
    return F.log(n - df + F.lit(0.5)) - F.log(df + F.lit(0.5))


@dataclass
class Statistics:
    """Of a collection: per index sizes, per index and term frequencies, and one row over all."""

    sizes: DataFrame  # index_id, n, total_length
    frequencies: DataFrame  # index_id, term, df
    overall: DataFrame  # n, avgdl, idf_mean

    @classmethod
    def of(cls, chunks: DataFrame) -> Statistics:
        return cls.from_tables(index_sizes(chunks), document_frequency(chunks))

    @classmethod
    def from_tables(cls, sizes: DataFrame, frequencies: DataFrame) -> Statistics:
        # the mean is over each index's own vocabulary and size, not over the joint one
        local = frequencies.join(F.broadcast(sizes), "index_id").agg(F.avg(raw_idf(F.col("n"), F.col("df"))).alias("idf_mean"))
        totals = sizes.agg(F.sum("n").alias("n"), F.sum("total_length").alias("total_length"))
        overall = totals.crossJoin(local).select(
            F.coalesce("n", F.lit(0)).alias("n"),
            F.when(F.col("n") > 0, F.col("total_length") / F.col("n")).otherwise(F.lit(1.0)).alias("avgdl"),
            F.coalesce("idf_mean", F.lit(0.0)).alias("idf_mean"),
        )
        return cls(sizes, frequencies, overall)

    def idf(self, terms: DataFrame) -> DataFrame:
        """term, qtf, df, idf of the terms that occur anywhere; negative weights are floored."""
        df = self.frequencies.join(F.broadcast(terms.select("term")), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
        raw = raw_idf(F.col("n"), F.col("df"))
        return (
            df.join(F.broadcast(terms), "term")
            .crossJoin(F.broadcast(self.overall))
            .select("term", "qtf", "df", F.when(raw < 0, F.lit(EPSILON) * F.col("idf_mean")).otherwise(raw).alias("idf"))
        )


def question_words(question: str) -> dict[str, int]:
    """Tokens of a question, as ``ident_tokens`` gives them, and how often each is asked for."""
    return dict(Counter(re.findall(TOKEN, re.sub(CAMEL, r"\1 \2", question).lower())))


def question_terms(spark, question: str) -> DataFrame:
    """term, qtf: a word asked for twice counts twice."""
    rows = [F.struct(F.lit(w).alias("term"), F.lit(n).cast("long").alias("qtf")) for w, n in question_words(question).items()]
    every = F.array(*rows).cast("array<struct<term:string,qtf:bigint>>")
    return spark.range(1).select(F.explode(every).alias("q")).select("q.term", "q.qtf")


def scores(hits: DataFrame, statistics: Statistics, terms: DataFrame) -> DataFrame:
    """index_id, row_id, score (rounded) of the chunks that hold some term and score above zero.

    ``hits`` has index_id, row_id, length, term and tf of at least the terms. A question's
    weights are few rows and are broadcast.
    """
    weights = F.broadcast(statistics.idf(terms).crossJoin(F.broadcast(statistics.overall.select("avgdl"))))
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("length") / F.col("avgdl"))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * F.lit(K1 + 1) / (F.col("tf") + norm)
    summed = hits.join(weights, "term").groupBy("index_id", "row_id").agg(F.round(F.sum(part), DIGITS).alias("score"))
    return summed.where(F.col("score") > 0)


def search(chunks: DataFrame, question: str, k: int) -> DataFrame:
    """The k best chunks: index_id, row_id, score, rank."""
    terms = question_terms(chunks.sparkSession, question)
    return ranked(scores(matches(chunks, question), Statistics.of(chunks), terms), k)


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k highest scores with their 1-based rank; ties by index and row. The limit comes first,
    so that the window that numbers the rows sees only k of them."""
    order = [F.desc("score"), F.asc("index_id"), F.asc("row_id")]
    return hits.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
