"""The queries of this folder, as ``__spark_entry__.py`` registers them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_count import count_documents
from .common import table
from .decontam import ORACLE as CONTAMINATION_SQL
from .decontam import contamination
from .langid import language
from .license_scan import scan_documents
from .packing import pack
from .pseudo_lm import score_documents
from .quality import quality
from .simhash import near_duplicates
from .toxicity import toxicity
from .vptree import nearest

BYTE_BPE = "byte_bpe_50k.json"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op5_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_license_scan": op2_license_scan,
    "op3_language_id": op3_language_id,
    "op4_packing": op4_packing,
    "op5_pseudo_likelihood": op5_pseudo_likelihood,
    "op6_quality": op6_quality,
    "op7_decontamination": op7_decontamination,
    "op8_nearest": op8_nearest,
    "op9_token_counts": op9_token_counts,
    "op10_toxicity": op10_toxicity,
}

ORACLES: dict[str, str] = {"op7_decontamination": CONTAMINATION_SQL}
