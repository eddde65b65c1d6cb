"""License scans by a positional index of rare words.

Templates of license notices are indexed by their words: each posting is (template, place). A
file's license words are looked up from the highest inverse document frequency on. Where one
is the rarest of a template's mandatory phrases, it says where the template would start; the
next rarest, RARE in all, must agree on that by their own places, give or take a few words and
more of them further on, as names and addresses are put in. Such starts are verified: all
mandatory phrases must stand there. How much of the template's weight the file holds around
the start is the score. A notice that says more than another gives its label in the other's
place.

Besides, three base phrases are counted wherever their words stand consecutively.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base phrases and their labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

_GPL = "this program is free software you can redistribute it and or modify it under the terms of the gnu {0}general public license as published by the free software foundation {1}"
_LATER = "either version {0} of the license or at your option any later version"
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation "
    "and or other materials provided with the distribution"
)
_BSD_PHRASES = ["redistribution and use in source and binary forms", "binary form must reproduce the above copyright notice"]

# Label, notice, and the phrases of it that must be present.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge to any person obtaining"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["permission notice shall be included in all copies or substantial portions"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ["apache license version 2 0", "except in compliance with the license"]),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license"]),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ["general public license version 2"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["general public license version 3"]),
    ("gpl-2.0-or-later", _GPL.format("", _LATER.format("2")), ["gnu general public license as published by", "either version 2 of the license or"]),
    ("gpl-3.0-or-later", _GPL.format("", _LATER.format("3")), ["gnu general public license as published by", "either version 3 of the license or"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("lgpl-2.1-or-later", _GPL.format("lesser ", _LATER.format("2 1")), ["gnu lesser general public license as published by", "either version 2 1 of the license or"]),
    ("lgpl-3.0-or-later", _GPL.format("lesser ", _LATER.format("3")), ["gnu lesser general public license as published by", "either version 3 of the license or"]),
    ("agpl", "licensed under the gnu affero general public license", ["affero general public license"]),
    ("agpl-3.0-or-later", _GPL.format("affero ", _LATER.format("3")), ["gnu affero general public license as published by", "either version 3 of the license or"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd-2-clause", _BSD, _BSD_PHRASES),
    ("bsd-3-clause", _BSD + " neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", [*_BSD_PHRASES, "endorse or promote products derived from this software"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at", ["eclipse public license 2 0"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify and or distribute this software"]),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ["will the authors be held liable for any damages", "alter it and redistribute it freely"]),
    ("bsl-1.0", "boost software license version 1 0", ["boost software license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights cc0", ["waived all copyright and related"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd 4 0"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike 4 0"]),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial 4 0"]),
    ("cc-by-nd", "licensed under a creative commons attribution noderivatives 4 0 international license", ["creative commons attribution noderivatives 4 0"]),
    ("cc-by-nc-sa", "licensed under a creative commons attribution noncommercial sharealike 4 0 international license", ["creative commons attribution noncommercial sharealike 4 0"]),
    ("proprietary", "all rights reserved unauthorized copying of this file via any medium is strictly prohibited", ["all rights reserved", "strictly prohibited"]),
]

# Notices that say more, and the labels whose place they take where both begin alike.
SAYS_MORE = {"bsd-3-clause": {"bsd-2-clause"}, "bsd-2-clause": {"bsd"}}

#: Share of a template's weight, by inverse document frequency, that a file must hold around one start.
ENOUGH = 0.5
#: Words by which a phrase may be displaced, as where a name was put in: some, and one more for each STRETCH words before it.
SLACK, STRETCH = 2, 16
#: Rarest words of a template's phrases that must agree.
RARE = 6


def slack(place: int) -> int:
    return SLACK + place // STRETCH


#: Bytes to what a word is made of: lower-case letters, digits and bytes of longer characters; else a space.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(TO_WORDS).split() if isinstance(text, str) else []


@dataclass
class Index:
    """Postings of all templates, and the weight of their words."""

    idf: dict[bytes, float]
    templates: list[tuple[str, list[bytes], list[list[bytes]]]] = field(default_factory=list)
    postings: dict[bytes, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))
    rare: list[list[bytes]] = field(default_factory=list)

    def __post_init__(self):
        for n, (label, notice, phrases) in enumerate(TEMPLATES):
            own = notice.encode().split()
            self.templates.append((label, own, [p.encode().split() for p in phrases]))
            for place, word in enumerate(own):
                self.postings[word].append((n, place))
            mandatory = {w for p in phrases for w in p.encode().split()}
            self.rare.append(sorted(mandatory, key=lambda w: (-self.idf[w], w))[:RARE])
        #: all words of a phrase are in a file that has the phrase, so looking up the rarest misses none
        self.keys = {own[0] for own in self.rare}

    def scan(self, words: list[bytes]) -> tuple[set[str], float]:
        """Labels found, and the highest share of a template that was verified."""
        places: dict[bytes, list[int]] = defaultdict(list)
        for at, word in enumerate(words):
            if word in self.postings:
                places[word].append(at)

        found: dict[tuple[int, str], float] = {}
        for word in sorted(places.keys() & self.keys, key=lambda w: (-self.idf[w], w)):
            for n, place in self.postings[word]:
                if word != self.rare[n][0]:
                    continue
                for start in (at - place for at in places[word]):
                    agree = all(any(self._near(places, w, start, p) for m, p in self.postings[w] if m == n) for w in self.rare[n][1:])
                    if agree and (share := self.verified(n, words, places, start)):
                        key = start, self.templates[n][0]
                        found[key] = max(share, found.get(key, 0.0))
        labels = set()
        for start, label in found:
            # a notice gives way only to one that begins where it does
            more = {l for s, l in found if label in SAYS_MORE.get(l, ()) and abs(s - start) <= 2 * SLACK}
            if not more:
                labels.add(label)
        return labels, min(max(found.values(), default=0.0), 1.0)

    @staticmethod
    def _near(places: dict[bytes, list[int]], word: bytes, start: int, place: int) -> bool:
        own, give = places.get(word, []), slack(place)
        at = bisect_left(own, start + place - give)
        return at < len(own) and own[at] <= start + place + give

    def verified(self, n: int, words: list[bytes], places: dict[bytes, list[int]], start: int) -> float:
        """Share of a template's weight around a start; 0 where a phrase lacks or the share is too small."""
        _, own, phrases = self.templates[n]
        if not all(self._stands(words, own, phrase, start) for phrase in phrases):
            return 0.0
        got = sum(self.idf[w] for p, w in enumerate(own) if self._near(places, w, start, p))
        share = got / sum(self.idf[w] for w in own)
        return share if share >= ENOUGH else 0.0

    @staticmethod
    def _stands(words: list[bytes], own: list[bytes], phrase: list[bytes], start: int) -> bool:
        place = next(i for i in range(len(own)) if own[i : i + len(phrase)] == phrase)
        lowest = max(0, start + place - slack(place))
        return any(words[at : at + len(phrase)] == phrase for at in range(lowest, max(lowest, start + place + slack(place) + 1)))


def base_hits(words: list[bytes]) -> list[tuple[int, int, str]]:
    """(first word, last word, label) of all places of all base phrases."""
    out = []
    for phrase, label in _base():
        last, before = phrase[-1], len(phrase) - 1
        at = -1
        while True:
            try:
                at = words.index(last, at + 1)
            except ValueError:
                break
            if at >= before and words[at - before : at + 1] == phrase:
                out.append((at - before, at, label))
    return out


@lru_cache(1)
def _base() -> list[tuple[list[bytes], str]]:
    return [(p.encode().split(), label) for p, label in BASE]


@lru_cache(1)
def template_words() -> list[bytes]:
    return sorted({w for _, notice, _ in TEMPLATES for w in notice.encode().split()})


def document_frequencies(docs: DataFrame) -> tuple[int, dict[bytes, int]]:
    """Rows of ``docs``, and in how many of them each template word stands: all rows count, and
    only one number a template word and partition is gathered."""
    vocabulary = template_words()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, rows, found = set(vocabulary), 0, defaultdict(int)
        for batch in batches:
            for text in batch["text"]:
                rows += 1
                for word in known.intersection(words_of(text)):
                    found[word] += 1
        yield pd.DataFrame({"word": ["", *[w.decode() for w in found]], "n": [rows, *found.values()]})

    counted = {r["word"]: r["n"] for r in docs.select("text").mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return counted.pop("", 0), {w.encode(): n for w, n in counted.items()}


def weights(rows: int, frequency: dict[bytes, int]) -> dict[bytes, float]:
    return {w: math.log((rows + 1) / (frequency.get(w, 0) + 1)) + 0.01 for w in template_words()}


RESULT = "doc_id string, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row, as in RESULT, for every row of ``docs`` (doc_id, text).

    n_base counts all places of base phrases; first_word and last_word are the smallest and
    largest word they start with, null without any. labels has the base labels and those of
    verified templates. score is the largest verified share of a template, 1 where a base
    phrase stands without one, 0 without any label. A null or empty text has no words;
    repeated rows are scanned each; an empty table gives an empty table; other columns are not
    read. A template that occurs several times is one label. Equal frequencies: words in
    alphabetical order.
    """
    idf = weights(*document_frequencies(docs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(idf)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = words_of(text)
                hits = base_hits(words)
                labels, score = index.scan(words)
                base = {label for _, _, label in hits}
                starts = [first for first, _, _ in hits]
                score = score or float(bool(base))
                out.append((doc_id, len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score))
            found = pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])
            yield found.astype({"n_words": "int64", "n_base": "int64", "first_word": "Int64", "last_word": "Int64"})

    # as text, since pandas would turn integers with nulls into floating point
    scanned = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, RESULT)
    return scanned.withColumn("doc_id", F.col("doc_id").cast("long"))
