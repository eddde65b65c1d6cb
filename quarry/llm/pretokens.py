"""Byte-level BPE of a ``tokenizers`` JSON file, one pre-token at a time.

``Vocabulary`` reads merges from the file. ``pieces`` cuts texts as the file's byte-level
pre-tokenizer does. Texts of characters below U+0100 take a plain pattern with the classes
spelled out, which the standard library matches several times faster; all others take
Unicode classes. Both cut alike.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import regex

# The pre-tokenizer's pattern, and the letters, numbers and spaces below U+0100.
UNICODE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACES = " \t\n\r\x0b\x0c\x85\xa0"

#: A place in a pre-token takes the lower 32 bits of a heap entry.
PLACES = (1 << 32) - 1

_wide = regex.compile(UNICODE)
_narrow = re.compile(
    rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)
_is_narrow = re.compile("[\x00-\x1b\x20-\xff]*").fullmatch


def pieces(text: str) -> list[str]:
    return (_narrow if _is_narrow(text) else _wide).findall(text)


@lru_cache(1)
def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    stand = dict(zip(shown, map(chr, shown), strict=True)) | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [stand[b] for b in range(256)]


class Vocabulary:
    """Symbols and merges of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or spec.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special_id = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = model["vocab"]
        self.byte_id = [vocab[c] for c in byte_alphabet()]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(vocab[a] << 20 | vocab[b], (rank << 32, vocab[a + b]))
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def ranks(self) -> dict[bytes, int] | None:
        """Bytes of each token by id, if ids below 256 are the bytes and the others the merges in order; else None."""
        tokens = {i: bytes([b]) for b, i in enumerate(self.byte_id)}
        for pair, (rank, new) in self.merges.items():
            if new != 256 + (rank >> 32) or (pair >> 20) >= new or (pair & (1 << 20) - 1) >= new or pair >> 20 not in tokens or pair & (1 << 20) - 1 not in tokens:
                return None
            tokens[new] = tokens[pair >> 20] + tokens[pair & (1 << 20) - 1]
        ranks = {t: i for i, t in tokens.items()}
        return ranks if sorted(ranks.values()) == list(range(256 + len(self.merges))) else None

    def spans(self, text: str) -> list[tuple[bool, str]]:
        """(is a special token, text) in order."""
        if self._cut is None or not any(s in text for s in self.special):
            return [(False, text)]
        return [(i % 2 == 1, part) for i, part in enumerate(self._cut.split(text)) if part]

    def merge(self, raw: bytes) -> tuple[list[int], int]:
        """Symbols left in the linked list after all merges, and how many merges took place.

        The heap holds rank and place of adjacent pairs, packed in one number; the lowest
        rank goes first, the leftmost of equals. ``pair`` has what each place would merge to
        now (None: nothing), so an entry of another rank is stale.
        """
        ids = [self.byte_id[b] for b in raw]
        end = len(ids)
        get = self.merges.get
        pair = [get(a << 20 | b) for a, b in zip(ids, ids[1:], strict=False)]
        heap = [found[0] | i for i, found in enumerate(pair) if found]
        if not heap:
            return ids, 0
        pair.append(None)
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        done = 0
        while heap:
            entry = pop(heap)
            i = entry & PLACES
            found = pair[i]
            if found is None or found[0] | i != entry:
                continue
            j = after[i]
            ids[i] = new = found[1]
            done += 1
            after[i] = k = after[j]
            ids[j], pair[j] = -1, None
            if k < end:
                before[k] = i
                pair[i] = found = get(new << 20 | ids[k])
                if found:
                    push(heap, found[0] | i)
            else:
                pair[i] = None
            h = before[i]
            if h >= 0:
                pair[h] = found = get(ids[h] << 20 | new)
                if found:
                    push(heap, found[0] | h)
        return ids, done


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    """One per worker process and path."""
    return Vocabulary(path)
