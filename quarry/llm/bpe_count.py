"""Token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pretokens import Vocabulary, pieces, vocabulary

#: Pre-tokens whose counts a worker remembers; beyond it the memory starts anew.
MEMORY = 600_000


class Counts(dict):
    """Tokens of a pre-token: its bytes less its merges; counted once, then remembered."""

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.vocab = vocab

    def __missing__(self, piece: str) -> int:
        raw = piece.encode("utf-8", "replace")
        n = len(raw) - self.vocab.merge(raw)[1]
        if len(piece) <= 64:
            if len(self) >= MEMORY:
                self.clear()
            self[piece] = n
        return n


def count_tokens(text: str | None, vocab: Vocabulary, counts: Counts | None = None) -> int:
    if not text:
        return 0
    look = (counts if counts is not None else Counts(vocab)).__getitem__
    return sum(1 if special else sum(map(look, pieces(part))) for special, part in vocab.spans(text))


def token_count(path: str) -> Callable[[Column], Column]:
    """A column function: tokens of a text (null: 0) by the BPE file at ``path`` on every worker."""

    @F.pandas_udf(T.LongType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocab = vocabulary(path)
        counts = Counts(vocab)
        for texts in batches:
            yield pd.Series([count_tokens(t, vocab, counts) for t in texts], dtype="int64")

    return run


def count_documents(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs``.

    A null text is empty: 0 bytes, 0 tokens. Repeated rows and null ids are counted row by
    row; an empty table gives an empty table; other columns, whatever their names, are not
    read. A text of any length is held by one task as one row, and its pre-tokens in a list.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), token_count(path)(F.col("text")).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


__all__ = ["Counts", "count_documents", "count_tokens", "token_count"]
