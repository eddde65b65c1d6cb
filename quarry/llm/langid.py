"""Language identification by error-correcting output codes.

Each language has a codeword of bits that differs from all others in many places. One binary
classifier over hashed byte n-grams predicts each bit. The nearest codeword, with the
classifiers' losses as weights, names the language; when two are about as near, the text is
flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, fold, sample_table, trained
from .features import Texts, sums

#: Labelled documents of each language that a training sample has at most.
SAMPLE = 500
BUCKETS, GRAMS = 1 << 16, (1, 2, 3)
EPOCHS, RATE = 10, 4.0
FOLDS, HELD = 4, 2
#: Languages up to which all different splits are bits; beyond it BITS_PER_DOUBLING random ones for each doubling.
EXHAUSTIVE, BITS_PER_DOUBLING = 5, 8
#: A lead of the nearest codeword below this share of all loss is ambiguous.
LEAD = 0.1
UNKNOWN = "und"


def codewords(n: int, seed: int = 3) -> np.ndarray:
    """n rows of -1 and 1. Of few languages all splits in two, each once; of many random
    balanced ones, the draw whose nearest rows are furthest apart among 50."""
    if n == 1:
        return np.ones((1, 1))
    if n <= EXHAUSTIVE:
        splits = [bits for bits in product((-1, 1), repeat=n) if bits[0] == 1 and min(bits) < 0]
        return np.array(splits).T.astype(float)
    bits, draw = int(np.ceil(BITS_PER_DOUBLING * np.log2(n))), np.random.default_rng(seed)
    half = np.array([1 if i % 2 else -1 for i in range(n)])
    best, apart = None, -1
    for _ in range(50):
        code = np.stack([draw.permutation(half) for _ in range(bits)], axis=1)
        agree = code @ code.T - 2 * bits * np.eye(n, dtype=int)
        if (distance := int((bits - agree.max()) // 2)) > apart:
            best, apart = code.astype(float), distance
    return best


def gram_buckets(t: Texts) -> np.ndarray:
    """n-grams at each place, for each n."""
    return np.stack([(t.grams(n) % np.uint64(BUCKETS)).astype(np.int32) for n in GRAMS])


def prepared(text: str | None) -> bytes:
    """Lower case, with single spaces, one in front."""
    return (" " + " ".join((text or "").lower().split())).encode("utf-8", "replace")


@dataclass
class Model:
    names: list[str]
    code: np.ndarray
    weight: np.ndarray  # buckets x bits
    bias: np.ndarray

    def margins(self, texts: list[bytes]) -> np.ndarray:
        t = Texts(texts)
        total = sum(sums(self.weight[g], t.starts, t.ends) for g in gram_buckets(t))
        return total / (len(GRAMS) * (t.ends - t.starts))[:, None] + self.bias

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword, confidence from 0 to 1, and whether the next one is about as near.

        The distance to a codeword is the sum of the bits' logistic losses.
        """
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]).sum(axis=2)
        order = np.sort(loss, axis=1)
        weight = np.exp(order[:, :1] - loss)
        lead = (order[:, 1] - order[:, 0]) / np.maximum(order.sum(axis=1), 1e-12) if loss.shape[1] > 1 else np.ones(len(loss))
        return loss.argmin(axis=1), 1 / weight.sum(axis=1), lead < LEAD

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        lang, score, doubt = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        at = 0
        told = [isinstance(t, str) and any(map(str.isalpha, t)) for t in texts]
        for part in chunks(" " if not ok else prepared(t).decode() for ok, t in zip(told, texts, strict=True)):
            which, sure, unclear = self.decode(self.margins(part))
            for i in range(len(part)):
                if told[at + i] and self.names:
                    lang[at + i], score[at + i], doubt[at + i] = self.names[which[i]], sure[i], unclear[i]
            at += len(part)
        return pd.DataFrame({"lang_pred": lang, "score": score, "ambiguous": doubt})


def train(sample: list[tuple[str, str]], seed: int = 4) -> Model:
    names = sorted({lang for _, lang in sample})
    code = codewords(max(1, len(names)))
    bits = code.shape[1]
    weight, bias = np.zeros((BUCKETS, bits), np.float32), np.zeros(bits)
    if len(names) < 2:
        return Model(names, code, weight, bias)
    bags = []
    for text, _ in sample:
        t = Texts([prepared(text)])
        found, times = np.unique(gram_buckets(t)[:, : t.ends[0]], return_counts=True)
        bags.append((found, (times / times.sum()).astype(np.float32)))
    target = code[[names.index(lang) for _, lang in sample]]
    draw, steps, total = np.random.default_rng(seed), 0, EPOCHS * len(bags)
    for _ in range(EPOCHS):
        for i in draw.permutation(len(bags)):
            rate = RATE * (1 - steps / total)
            steps += 1
            found, share = bags[i]
            pull = target[i] / (1 + np.exp(target[i] * (share @ weight[found] + bias)))
            weight[found] += (rate * len(found) ** 0.5 * share)[:, None] * pull.astype(np.float32)
            bias += 0.01 * rate * pull
    return Model(names, code, weight, bias)


RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])


def predictor(spark, model: Model) -> Callable[[Column], Column]:
    held = spark.sparkContext.broadcast(model)  # BUCKETS rows of one number a bit, whatever the input

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield held.value.predict(texts.tolist())

    return run


def language(docs: DataFrame, per_language: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every row of ``docs`` (doc_id, text, lang).

    The classifiers learn from at most SAMPLE documents of each non-null lang outside the
    held-out fold. A text that is null or has no letter is ``und`` with score 0 and ambiguous,
    and so is every text where there was nothing to learn; where one language was, it is that
    of all others with score 1. Repeated rows are predicted each; an empty table gives an
    empty table; other columns are not read. Every byte of a text counts, however long it is.
    """
    learn = fold(F.col("doc_id"), FOLDS) != HELD
    labels = docs.where(learn).select("doc_id", F.col("lang").alias("label"))
    model = trained(sample_table(docs.select("doc_id", "text"), labels, learn, per_language, seed=3), train)
    found = docs.select("doc_id", (~learn).alias("held_out"), predictor(docs.sparkSession, model)(F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.ambiguous")
