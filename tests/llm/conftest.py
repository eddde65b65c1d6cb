import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the river runs over stones while small birds sing about morning light and cold wind moves dry leaves along an old road near quiet houses".split()


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + draw.choice(["", "", "", "s", "ed", "ing"]) for _ in range(n))


#: Null ids and texts, empty and blank texts, a repeated row, ties, a text of many words, bytes of all lengths.
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "a"),
    (None, "no id here at all"),
    (5, "same words again and again"),
    (5, "same words again and again"),
    (6, "same words again and again"),
    (7, prose(1, 6000)),
    (8, "日本語 ñandú École 😀 !!"),
    (9, "word " * 700),
]


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, **extra):
        full = [(i, t, "en", "s", len(t or ""), *extra.values()) for i, t in rows]
        kinds = "".join(f", `{name}` string" for name in extra)
        return spark.createDataFrame(full, DOCS + kinds).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd(docs_of):
    """With columns whose names clash with those that operators make."""
    return docs_of(ODD, score="x", key="y", fp="z", mark="m", held_out="h", word="w")
