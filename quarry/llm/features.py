"""Hashed words and character n-grams of many texts at a time, as flat arrays."""

from __future__ import annotations

import numpy as np

MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0x100000001B3)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Neither a letter nor a digit of ASCII, nor part of a longer character.
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


#: Spaces after each text, so that no n-gram that begins in one reaches the next.
GAP = 4
#: Words that are hashed at a time.
BLOCK = 1 << 16


class Texts:
    """The bytes of some texts, and where their words lie. A text's range has one space after it;
    what is found in a range depends on that text alone."""

    def __init__(self, texts: list[bytes], separators: np.ndarray = SPACE, lower: bool = False):
        self.count = len(texts)
        gap = b" " * GAP
        data = np.frombuffer(gap.join(texts) + gap, np.uint8)
        self.data = LOWER[data] if lower else data
        lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(lengths + GAP) - lengths - GAP
        self.ends = self.starts + lengths + 1
        inside = ~separators[self.data]
        inside[self.ends - 1] = False
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
        self.word_start = np.flatnonzero(edge == 1)
        self.word_end = np.flatnonzero(edge == -1)
        self.word_doc = np.searchsorted(self.ends, self.word_start, side="right")
        #: words of text i are word_from[i] to word_from[i + 1] - 1
        self.word_from = np.searchsorted(self.word_doc, np.arange(self.count + 1))

    def words(self) -> np.ndarray:
        """A 64-bit hash of each word, from its bytes alone; some words at a time, to hold less."""
        out = np.empty(len(self.word_start), np.uint64)
        for i in range(0, len(out), BLOCK):
            start, lengths = self.word_start[i : i + BLOCK], (self.word_end - self.word_start)[i : i + BLOCK]
            first = np.cumsum(lengths) - lengths
            place = np.arange(lengths.sum()) - np.repeat(first, lengths)
            own = self.data[place + np.repeat(start, lengths)].astype(np.uint64) + np.uint64(1)
            out[i : i + BLOCK] = mixed(np.add.reduceat(own * powers(int(lengths.max()))[place], first))
        return out

    def grams(self, n: int) -> np.ndarray:
        """A 64-bit hash of the n bytes from each place on, n up to GAP."""
        data = np.concatenate([self.data, np.full(n - 1, 32, np.uint8)]).astype(np.uint64)
        code = data[: len(self.data)].copy()
        for k in range(1, n):
            code = code << np.uint64(8) | data[k : k + len(self.data)]
        return mixed(code + np.uint64(n) * BASE)


class Characters:
    """The characters of some texts as numbers; a text's range has one space after it."""

    def __init__(self, texts: list[bytes]):
        own = [t.decode("utf-8", "replace") for t in texts]
        gap = " " * GAP
        self.data = np.frombuffer((gap.join(own) + gap).encode("utf-32-le", "replace"), np.uint32)
        lengths = np.array([len(t) for t in own], np.int64)
        self.starts = np.cumsum(lengths + GAP) - lengths - GAP
        self.ends = self.starts + lengths + 1

    def grams(self, n: int) -> np.ndarray:
        """A 64-bit hash of the n characters from each place on, n up to GAP."""
        data = np.concatenate([self.data, np.full(n - 1, 32, np.uint32)]).astype(np.uint64)
        code = data[: len(self.data)].copy()
        for k in range(1, n):
            code = code * BASE + data[k : k + len(self.data)]
        return mixed(code + np.uint64(n) * BASE)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * MIX
    return x ^ x >> np.uint64(29)


def powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), BASE, np.uint64)]))


def sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of values[starts[i]:ends[i]]; 0 where that is empty. Ranges are in order and don't overlap."""
    out = np.zeros((len(starts), *values.shape[1:]), np.float64)
    full = np.flatnonzero(ends > starts)
    if len(full):
        edges = np.stack([starts[full], ends[full]], axis=1).ravel()
        edges = edges[:-1] if edges[-1] == len(values) else edges
        out[full] = np.add.reduceat(values, edges, axis=0, dtype=np.float64)[::2]
    return out
