"""Chunk collections derived from the driver's tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks: one index for each language, every fifth path in a test folder, every third a markdown file."""
    d = table(spark, sf_dir, "documents")
    folder = F.when(F.col("doc_id") % 5 == 0, "tests").otherwise("src")
    suffix = F.when(F.col("doc_id") % 3 == 0, ".md").otherwise(".py")
    file = F.concat(F.lit("/ws/"), "lang", F.lit("/"), "source", F.lit("/"), folder, F.lit("/d"), F.col("doc_id").cast("string"), suffix)
    return d.select(F.col("lang").alias("index_id"), F.col("doc_id").alias("row_id"), file.alias("file"), "text")


CHUNKS = """chunks AS (
  SELECT lang AS index_id, doc_id AS row_id, '/ws/' || lang || '/' || source || '/' || CASE WHEN doc_id % 5 = 0 THEN 'tests' ELSE 'src' END
    || '/d' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.md' ELSE '.py' END AS file, text
  FROM documents
)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as vectors of one index for each label."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.concat(F.lit("v"), F.col("label").cast("string")).alias("index_id"), F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"))


VECTORS = "vectors AS (SELECT 'v' || label AS index_id, vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings)"


#: Ids of vectors that are sent to every task, at most; beyond, the join alone finds the chunks that have one.
IDS = 1_000_000


def hybrid_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that have a vector, joined on doc_id = vec_id; texts that have none are not shuffled for the join."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"))
    c = chunks(spark, sf_dir)
    if e.count() <= IDS:
        c = c.join(F.broadcast(e.select("row_id")), "row_id", "left_semi")
    return c.join(e, "row_id")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("query"))
