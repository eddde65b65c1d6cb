"""Bounded-space online packing of tokenized documents into training sequences."""

from __future__ import annotations

import os
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .pretokens import UNICODE, Vocabulary, vocabulary

#: Windows that a partition keeps open at a time.
OPEN_WINDOWS = 256
#: Partitions whose leftover windows are merged together; bounds a merge to that many times OPEN_WINDOWS.
MERGE_PARTITIONS = 32
#: Characters of a run without, or of nothing but, white space from which a text counts as unusual.
LONG_RUN = 1000
#: Ends every document.
END = b"\0\0\0\0"

PIECES = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


class Encoder:
    """Documents to little-endian 32-bit ids, as the file's own library gives them.

    Where the file's ids are its merges in order, as byte-level vocabularies have them, another
    library that merges by ids gives the same, faster. It slows down on runs that nothing cuts,
    so texts with a long one, and files with another order, go to the file's own library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        vocab: Vocabulary = vocabulary(path)
        ranks = vocab.ranks()
        self.fast = ranks and tiktoken.Encoding("file", pat_str=UNICODE, mergeable_ranks=ranks, special_tokens=vocab.special_id)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return END
        words = text.split()
        plain = len(text) - sum(map(len, words)) < len(words) + LONG_RUN and max(map(len, words), default=0) < LONG_RUN
        ids = self.fast.encode(text, allowed_special="all") if self.fast and plain else self.model.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids) + END


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Windows:
    """At most ``most`` open windows of ``size`` tokens. Best fit; the fullest leaves when none fits."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.room: list[tuple[int, int]] = []  # (free tokens, window), ascending
        self.held: dict[int, list] = {}
        self.next = 0

    def place(self, length: int, what: object) -> list[list]:
        """Put ``what`` into a window; gives back what was in the windows that this closed."""
        closed = []
        at = bisect_left(self.room, (length, -1))
        if at < len(self.room):
            free, window = self.room.pop(at)
        else:
            if len(self.room) >= self.most:
                closed.append(self.held.pop(self.room.pop(0)[1]))
            free, window = self.size, self.next
            self.next += 1
            self.held[window] = []
        self.held[window].append((self.size - free, length, what))
        if free == length:
            closed.append(self.held.pop(window))
        else:
            insort(self.room, (free - length, window))
        return closed

    def rest(self) -> list[list]:
        return [self.held[window] for _, window in self.room]


def _rows(window: list, sequence: int) -> Iterator[tuple]:
    total = sum(length for _, length, _ in window)
    for offset, length, (doc_id, start, crc, doc_tokens) in window:
        yield doc_id, start, length, crc, doc_tokens, sequence, offset, total


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names)


def pack(docs: DataFrame, path: str, size: int = 1024, most: int = OPEN_WINDOWS) -> DataFrame:
    """Pieces of all rows of ``docs`` (doc_id, text) in sequences of at most ``size`` tokens.

    Each partition encodes its documents in order, cuts full sequences off documents longer
    than ``size``, and puts what remains into the open window with the least sufficient room;
    when none has room, the fullest is closed. The windows still open at the end of the
    partitions are merged, MERGE_PARTITIONS partitions together, by the same rule, longest
    piece first. A lost task repeats its own partition; what is written stays as it is.

    A null or empty text is a document of the end id alone. Repeated rows and null ids are
    packed row by row, an empty table gives no rows, and other columns are not read. Ties of
    room go to the older window. Columns: see PIECES; sequence_tokens is what the sequence
    holds, and its padding is size - sequence_tokens unless that is a power of two.
    """
    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        code = encoder(path)
        windows = Windows(size, most)
        sequences = iter(range(part << 33, (part + 1) << 33, 2))
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                raw = code.encode(text)
                tokens = len(raw) // 4
                for start in range(0, tokens, size):
                    ids = raw[4 * start : 4 * (start + size)]
                    piece = (doc_id, start, zlib.crc32(ids), tokens)
                    for window in [[(0, size, piece)]] if len(ids) == 4 * size else windows.place(len(ids) // 4, piece):
                        out += _rows(window, next(sequences))
            yield _frame([(*r, False, part) for r in out], [*names, "open", "part"])
        rest = [r for window in windows.rest() for r in _rows(window, next(sequences))]
        yield _frame([(*r, True, part) for r in rest], [*names, "open", "part"])

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        windows = Windows(size, len(group) + 1)
        sequences = iter(range((key[0] << 33) + 1, (key[0] + 1) << 33, 2))
        out: list[tuple] = []
        for r in group.sort_values(["length", "sequence_id", "offset"], ascending=[False, True, True]).itertuples(index=False):
            for window in windows.place(r.length, (r.doc_id, r.start, r.ids_crc32, r.doc_tokens)):
                out += _rows(window, next(sequences))
        for window in windows.rest():
            out += _rows(window, next(sequences))
        return _frame(out, names)

    # ids as text, since pandas would turn integers with nulls into floating point
    placed = materialize(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, f"{PIECES}, open boolean, part long"), "packed")
    closed = placed.where(~F.col("open")).select(names)
    merged = placed.where("open").withColumn("group", F.expr(f"part div {MERGE_PARTITIONS}")).groupBy("group").applyInPandas(merge, PIECES)
    return closed.unionByName(merged).withColumn("doc_id", F.col("doc_id").cast("long"))
