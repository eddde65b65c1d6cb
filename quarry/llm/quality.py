"""Quality classifier of supervised subword embeddings.

A document is the mean of learned vectors: one for each word, one for each run of three and
four characters (both hashed to buckets), and one for each word that repeats the word before it. A
softmax over two outputs follows. Vectors and outputs are trained by stochastic gradient
descent in numpy on a bounded sample of labelled documents. Scoring needs no vector: the
output is linear in the mean, so each bucket's part of it is computed once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, fold, sample_table, trained
from .features import Characters, Texts, sums

#: Labelled documents of each class that a training sample has at most.
SAMPLE = 2000
BUCKETS, DIM = 1 << 17, 8
EPOCHS, RATE = 12, 0.5
GRAMS = (3, 4)
THRESHOLD, FOLDS, HELD = 0.3, 5, 0
REPEAT = 0  # the bucket of words that repeat the word before


@dataclass
class Model:
    weight: np.ndarray  # each bucket's part of the log odds
    bias: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        t = Texts(texts)
        words = buckets(t)
        total = sums(self.weight[words], t.word_from[:-1], t.word_from[1:])
        again = repeats(t, words)
        total += np.bincount(t.word_doc[again], minlength=t.count) * float(self.weight[REPEAT])
        count = np.diff(t.word_from) + np.bincount(t.word_doc[again], minlength=t.count)
        letters = Characters(texts)
        for n in GRAMS:
            total += sums(self.weight[gram_buckets(letters, n)], letters.starts, letters.ends)
            count = count + (letters.ends - letters.starts)
        return 1 / (1 + np.exp(-np.clip(total / count + self.bias, -30, 30)))


def buckets(t: Texts) -> np.ndarray:
    return (t.words() % np.uint64(BUCKETS - 1)).astype(np.int32) + 1


def gram_buckets(t: Characters, n: int) -> np.ndarray:
    return (t.grams(n) % np.uint64(BUCKETS - 1)).astype(np.int32) + 1


def repeats(t: Texts, words: np.ndarray) -> np.ndarray:
    same = np.flatnonzero((words[1:] == words[:-1]) & (t.word_doc[1:] == t.word_doc[:-1]))
    return same + 1


def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of one document, and their share of all its features."""
    t, letters = Texts([text]), Characters([text])
    words = buckets(t)
    grams = [gram_buckets(letters, n)[: letters.ends[0]] for n in GRAMS]
    every = np.concatenate([words, np.full(len(repeats(t, words)), REPEAT, np.int32), *grams])
    found, times = np.unique(every, return_counts=True)
    return found, (times / len(every)).astype(np.float32)


def train(sample: list[tuple[str, int]], seed: int = 7) -> Model:
    """Softmax over the mean of bucket vectors. Without two classes: the smoothed prior."""
    labels = np.array([int(label == 1) for _, label in sample])
    ones = int(labels.sum())
    if ones in (0, len(labels)):
        return Model(np.zeros(BUCKETS, np.float32), float(np.log((ones + 1) / (len(labels) - ones + 1))))
    bags = [bag(text.encode("utf-8", "replace")) for text, _ in sample]
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((2, DIM), np.float32)
    bias = np.zeros(2, np.float32)
    # each class has half of the weight, so that the threshold doesn't depend on the sample's shares
    weigh = np.array([len(labels) / (2 * (len(labels) - ones)), len(labels) / (2 * ones)], np.float32)
    steps, total = 0, EPOCHS * len(bags)
    for _ in range(EPOCHS):
        for i in draw.permutation(len(bags)):
            rate = RATE * (1 - steps / total)
            steps += 1
            found, share = bags[i]
            mean = share @ vectors[found]
            logit = out @ mean + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= weigh[labels[i]]
            back = out.T @ p
            out -= rate * np.outer(p, mean)
            bias -= rate * 0.1 * p
            vectors[found] -= (rate * len(found) ** 0.5 * share)[:, None] * back
    return Model(vectors @ (out[1] - out[0]), float(bias[1] - bias[0]))


def scorer(spark, model: Model) -> Callable[[Column], Column]:
    held = spark.sparkContext.broadcast(model)  # BUCKETS numbers, whatever the input

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = [held.value.score(part) for part in chunks(texts)]
            yield pd.Series(np.concatenate(found) if found else np.empty(0))

    return run


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> Model:
    labels = labels.select("doc_id", F.col("quality").alias("label")).where(F.col("label").isin(0, 1))
    return trained(sample_table(docs.select("doc_id", "text"), labels, fold(F.col("doc_id"), FOLDS) != HELD, per_class, seed=6), train)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text).

    The model learns from at most SAMPLE documents of each label outside the held-out fold;
    labels other than 0 and 1 are ignored. With one class alone, or none, the score is the
    smoothed share of label 1 for all. A null or empty text is scored as the separator that
    follows every text. Repeated rows are scored each; an empty table gives an empty table;
    other columns are not read. A text of any length is summed up in arrays of its length.
    """
    model = fit(docs, labels)
    found = docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), scorer(docs.sparkSession, model)(F.col("text")).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the classifier does not reject.

    Every row is judged by its own text and as ``quality`` judges it: null and empty texts by
    the score they have there, repeated rows each, rows without an id like any others. Without
    two classes of labels all rows have one score, which is kept from the threshold on.
    """
    return docs.where(scorer(docs.sparkSession, fit(docs, labels))(F.col("text")) >= threshold)
