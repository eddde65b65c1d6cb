"""The corpus pipeline: what is left of ``documents`` after filtering, as packed sequences.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last keep the columns of documents, whatever
others there are. Every row is judged by its own text. An empty table passes every stage, and
``labels`` and ``benchmark`` may be empty too.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import materialize, table
from quarry.llm.decontam import keep_uncontaminated
from quarry.llm.packing import pack
from quarry.llm.quality import keep_good
from quarry.llm.queries import BYTE_BPE
from quarry.llm.simhash import keep_one
from quarry.llm.toxicity import keep_civil


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    A null or empty text is scored like one space. Repeated rows stay or go together; rows
    without an id are judged like others, but are not learnt from. Without two labels to learn
    from all texts have one score. Texts are scored whole, however long they are.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic.

    All windows of a text count, however long it is. A null text, or one without words, has the
    score of the network's bias. Repeated rows stay or go together; rows without an id are judged
    like others, but are not learnt from.
    """
    return keep_civil(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id.

    Null texts, empty ones and those without words are one group. Of rows with the same id and
    text one stays; unlike texts of one id all stay. A row without an id stays only if no row of
    its group has one, and then one row of the group does.
    """
    return keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no run of any item of the benchmark: 8 words, or a whole shorter item.

    Null and empty texts stay, as do all where the benchmark has no words. Items without an id
    hit nothing. Repeated rows stay or go together.
    """
    return keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"), least=1)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in sequences of 1024 tokens.

    A null or empty text is a document of the end id alone. Every row is packed, repeated ones
    and those without an id too; a text longer than a sequence is cut.
    """
    return pack(docs, public_tokenizers.path(BYTE_BPE))


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Classifiers and tokens can't be expressed in SQL; tests/llm/test_pipeline.py judges every stage's texts one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
