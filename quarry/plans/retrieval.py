"""Queries of tokens, statistics, keyword and vector search, and their fusion."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import CODE_EXTENSIONS, TEST_PATH, TOKEN, ident_tokens
from ..operators import bm25, fusion, search, vector
from . import corpora
from .indexed import indexes
from .corpora import CHUNKS, VECTORS

VEC = 7
TOKENS = f"regexp_extract_all(lower(regexp_replace(text, '([a-z])([A-Z])', '\\1 \\2', 'g')), '{TOKEN}')"


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpora.table(spark, sf_dir, "documents").select("doc_id", ident_tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


def _stats(chunks: DataFrame) -> DataFrame:
    o = bm25.Statistics.of(chunks).overall
    return o.select(F.col("n").cast("long").alias("n"), F.round("avgdl", 9).alias("avgdl"), F.round("idf_mean", 9).alias("idf_mean"))


def _only(name: str):
    def some(spark: SparkSession, sf_dir: str) -> DataFrame:
        return corpora.chunks(spark, sf_dir).where(F.col("index_id") == name)

    return some


def _several(*names: str):
    def some(spark: SparkSession, sf_dir: str) -> DataFrame:
        return corpora.chunks(spark, sf_dir).where(F.col("index_id").isin(*names))

    return some


def _statistics_sql(where: str) -> str:
    return f"""{CHUNKS}, own AS (SELECT * FROM chunks WHERE {where}),
tok AS (SELECT index_id, row_id, {TOKENS} AS t FROM own),
len AS (SELECT index_id, row_id, CAST(len(t) AS BIGINT) AS length FROM tok),
tf AS (SELECT index_id, row_id, term, count(*) AS tf FROM (SELECT index_id, row_id, unnest(t) AS term FROM tok) GROUP BY ALL),
df AS (SELECT index_id, term, count(*) AS df FROM tf GROUP BY ALL),
size AS (SELECT index_id, count(*) AS n, sum(length) AS total FROM len GROUP BY ALL),
overall AS (
  SELECT (SELECT CAST(sum(n) AS BIGINT) FROM size) AS n, (SELECT CAST(sum(total) AS DOUBLE) / CAST(sum(n) AS DOUBLE) FROM size) AS avgdl,
    (SELECT avg(ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE)) FROM df JOIN size USING (index_id)) AS idf_mean
)"""


def _question_sql(question: str) -> str:
    words = Counter(re.findall(TOKEN, re.sub("([a-z])([A-Z])", r"\1 \2", question).lower()))
    rows = ", ".join(f"('{w}', {n})" for w, n in words.items())
    return f"""q AS (SELECT * FROM (VALUES {rows}) AS v(term, qtf)),
w AS (
  SELECT term, qtf, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * idf_mean ELSE raw END AS idf FROM (
    SELECT term, any_value(qtf) AS qtf, CAST(sum(df) AS BIGINT) AS df, ln(any_value(n) - sum(df) + 0.5::DOUBLE) - ln(sum(df) + 0.5::DOUBLE) AS raw, any_value(idf_mean) AS idf_mean
    FROM df JOIN q USING (term), overall GROUP BY term)
),
bm AS (
  SELECT index_id, row_id, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avgdl))), 9) AS score
  FROM tf JOIN w USING (term) JOIN len USING (index_id, row_id), overall GROUP BY ALL
)"""


def _keyword_sql(where: str, question: str, k: int) -> str:
    return f"""WITH {_statistics_sql(where)}, {_question_sql(question)}
SELECT index_id, row_id, score, CAST(row_number() OVER (ORDER BY score DESC, index_id, row_id) AS INTEGER) AS rank FROM bm WHERE score > 0
ORDER BY score DESC, index_id, row_id LIMIT {k}"""


def _dot_sql(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


def _cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.search(corpora.vectors(spark, sf_dir), corpora.query_vector(spark, sf_dir, VEC), 30)


def _cosine_per_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.search_per_index(corpora.vectors(spark, sf_dir), corpora.query_vector(spark, sf_dir, VEC), 10)


COSINE = f"""WITH {VECTORS}, s AS (
  SELECT index_id, row_id, round({_dot_sql("vector", f"(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {VEC})")}, 9) AS score FROM vectors
)"""


def _hybrid(question: str, k: int, names: tuple[str, ...] = (), folder: str | None = None):
    """Over stored indexes, over chunks that are tokenized as they are asked, and in SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = indexes(spark, sf_dir, "hybrid")
        return (own.only(*names) if names else own).hybrid(corpora.query_vector(spark, sf_dir, VEC), question, k, folder)

    def unstored(spark: SparkSession, sf_dir: str) -> DataFrame:
        chunks = corpora.hybrid_chunks(spark, sf_dir)
        return search.hybrid(chunks.where(F.col("index_id").isin(*names)) if names else chunks, corpora.query_vector(spark, sf_dir, VEC), question, k, folder)

    where = f"index_id IN ({', '.join(map(repr, names))})" if names else "true"
    size = fusion.fetch_size(k, folder)
    tests = bool(re.search(r"\b(test|tests|testing|spec|specs|mock|mocks|fixture|fixtures)\b", question.lower()))
    path = TEST_PATH.removeprefix("(?i)")
    code = "(" + "|".join(re.escape(e) for e in CODE_EXTENSIONS) + ")$"
    sql = f"""WITH {_statistics_sql(f"row_id IN (SELECT vec_id FROM embeddings) AND {where}")}, {_question_sql(question)},
{_lists_sql(size)},
hit AS (
  SELECT index_id, row_id, file, vector_rank, keyword_rank, round(fused * CASE WHEN {str(not tests).lower()} AND regexp_matches(file, '{path}', 'i') AND regexp_matches(file, '{code}') THEN 0.5::DOUBLE ELSE 1::DOUBLE END, 12) AS fused
  FROM rrf JOIN own USING (index_id, row_id) {f"WHERE starts_with(file, '{folder}')" if folder else ""}
)
SELECT CAST(row_number() OVER (ORDER BY fused DESC, vector_rank ASC NULLS LAST, keyword_rank ASC NULLS LAST, index_id, row_id) AS INTEGER) AS rank, index_id, row_id, file, fused
FROM hit ORDER BY rank LIMIT {k}"""
    return run, unstored, sql


def _lists_sql(size: int) -> str:
    return f"""vec AS (
  SELECT index_id, row_id, round({_dot_sql("CAST(embedding AS DOUBLE[])", f"(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {VEC})")}, 9) AS score
  FROM own JOIN embeddings ON row_id = vec_id
),
a AS (SELECT index_id, row_id, row_number() OVER (ORDER BY score DESC, index_id, row_id) AS rank FROM vec QUALIFY rank <= {size}),
b AS (SELECT index_id, row_id, row_number() OVER (ORDER BY score DESC, index_id, row_id) AS rank FROM bm WHERE score > 0 QUALIFY rank <= {size}),
rrf AS (
  SELECT index_id, row_id, sum(1::DOUBLE / (60 + rank)) AS fused, max(vr) AS vector_rank, max(kr) AS keyword_rank
  FROM (SELECT index_id, row_id, rank, rank AS vr, NULL AS kr FROM a UNION ALL SELECT index_id, row_id, rank, NULL, rank FROM b) GROUP BY ALL
)"""


def _rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = indexes(spark, sf_dir, "hybrid")
    nearest = vector.search(own.chunks, corpora.query_vector(spark, sf_dir, VEC), 30)
    fused = fusion.fuse(nearest, own.keyword("shou lynt lynt", 30))
    return fused.select("index_id", "row_id", F.round("fused", 12).alias("fused"), "vector_rank", "keyword_rank")


RRF = f"""WITH {_statistics_sql("row_id IN (SELECT vec_id FROM embeddings)")}, {_question_sql("shou lynt lynt")}, {_lists_sql(30)}
SELECT index_id, row_id, round(fused, 12) AS fused, CAST(vector_rank AS INTEGER) AS vector_rank, CAST(keyword_rank AS INTEGER) AS keyword_rank FROM rrf"""

QUERIES = {
    "ident_tokens": _tokens,
    "term_frequency": lambda spark, d: bm25.postings(corpora.chunks(spark, d)),
    "doc_frequency": lambda spark, d: bm25.document_frequency(corpora.chunks(spark, d)),
    "chunk_length": lambda spark, d: bm25.lengths(corpora.chunks(spark, d)),
    "corpus_stats_single": lambda spark, d: _stats(_only("en")(spark, d)),
    "corpus_stats_multi": lambda spark, d: _stats(corpora.chunks(spark, d)),
    "idf_floor": lambda spark, d: bm25.Statistics.of(c := _several("en", "fr")(spark, d)).idf(bm25.question_terms(c.sparkSession, "the shou lynt and the zzz")).select(
        "term", "qtf", "df", F.round("idf", 9).alias("idf")
    ),
    "bm25_topk": lambda spark, d: indexes(spark, d).only("en").keyword("shou lynt", 20),
    "bm25_multi_index": lambda spark, d: indexes(spark, d).only("en", "fr").keyword("shou lynt the queeux", 30),
    "bm25_repeated_term": lambda spark, d: indexes(spark, d).keyword("lynt lynt shou", 30),
    "bm25_unstored": lambda spark, d: bm25.search(_several("en", "fr")(spark, d), "shou lynt the queeux", 30),
    "stored_sizes": lambda spark, d: indexes(spark, d).sizes.select("index_id", "n", "total_length", "terms", F.round("idf_sum", 6).alias("idf_sum")),
    "cosine_topk": _cosine,
    "cosine_topk_per_index": _cosine_per_index,
    "rrf_fusion": _rrf,
}
ORACLES = {
    "ident_tokens": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {TOKENS} AS t FROM documents)",
    "term_frequency": f"WITH {_statistics_sql('true')} SELECT * FROM tf",
    "doc_frequency": f"WITH {_statistics_sql('true')} SELECT * FROM df",
    "chunk_length": f"WITH {_statistics_sql('true')} SELECT * FROM len",
    "corpus_stats_single": "WITH " + _statistics_sql("index_id = 'en'") + " SELECT n, round(avgdl, 9) AS avgdl, round(idf_mean, 9) AS idf_mean FROM overall",
    "corpus_stats_multi": "WITH " + _statistics_sql("true") + " SELECT n, round(avgdl, 9) AS avgdl, round(idf_mean, 9) AS idf_mean FROM overall",
    "idf_floor": "WITH " + _statistics_sql("index_id IN ('en', 'fr')") + ", " + _question_sql("the shou lynt and the zzz") + " SELECT term, CAST(qtf AS BIGINT) AS qtf, df, round(idf, 9) AS idf FROM w",
    "bm25_topk": _keyword_sql("index_id = 'en'", "shou lynt", 20),
    "bm25_multi_index": _keyword_sql("index_id IN ('en', 'fr')", "shou lynt the queeux", 30),
    "bm25_unstored": _keyword_sql("index_id IN ('en', 'fr')", "shou lynt the queeux", 30),
    "stored_sizes": "WITH " + _statistics_sql("true") + """ SELECT index_id, n, CAST(total AS BIGINT) AS total_length, terms, idf_sum FROM size JOIN (
  SELECT index_id, count(*) AS terms, round(sum(ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE)), 6) AS idf_sum FROM df JOIN size USING (index_id) GROUP BY index_id) USING (index_id)""",
    "bm25_repeated_term": _keyword_sql("true", "lynt lynt shou", 30),
    "cosine_topk": COSINE + " SELECT index_id, row_id, score, CAST(row_number() OVER (ORDER BY score DESC, index_id, row_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 30",
    "cosine_topk_per_index": COSINE + " SELECT index_id, row_id, score, CAST(row_number() OVER (PARTITION BY index_id ORDER BY score DESC, row_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10",
    "rrf_fusion": RRF,
}
for _name, _arguments in {
    "hybrid_search": ("shou lynt", 10, ("en",)),
    "hybrid_multi_index": ("shou lynt lynt", 10),
    "hybrid_test_penalty": ("onhe thion the", 10),
    "hybrid_wants_tests": ("asking test lynt", 10),
    "hybrid_folder_filter": ("shou lynt lynt", 10, (), "/ws/en/"),
    "hybrid_no_keyword_hit": ("zzz", 10),
}.items():
    QUERIES[_name], _unstored, ORACLES[_name] = _hybrid(*_arguments)
    if _name == "hybrid_multi_index":
        QUERIES["hybrid_unstored"], ORACLES["hybrid_unstored"] = _unstored, ORACLES[_name]
