"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input is a learned vector of its hash beside the mean of learned vectors of its byte
trigrams. The network reads windows of WINDOW words that overlap, in both directions; attention
pools the states of a window, and a document's score is that of its worst window. Only whole
documents have labels, so training picks the windows: first those with the words that labelled
documents disagree on most, then those that the network itself finds worst.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, fold, sample_table, trained
from .features import BASE, NOT_WORD, Texts, mixed

#: Labelled documents of each class that a training sample has at most.
SAMPLE = 1500
WINDOW, STEP = 32, 24
WORDS, GRAMS, DIM, HIDDEN = 1 << 15, 1 << 13, 8, 8
EPOCHS, ROUNDS, BATCH, RATE = 3, 3, 64, 0.05
#: Windows that are scored, and words whose vectors are made, at a time.
BLOCK, WORDS_HELD = 2048, 8192
THRESHOLD, FOLDS, HELD = 0.7, 3, 1

f32 = np.float32


class Lexicon:
    """The distinct words of some texts, what they are made of, and each text's words by number."""

    def __init__(self, texts: list[bytes]):
        t = Texts(texts, NOT_WORD, lower=True)
        words = t.words()
        order = np.argsort(words, kind="stable")  # rather than np.unique, which holds more at a time
        words = words[order]
        new = np.append(True, words[1:] != words[:-1])[: len(words)]
        hashes, first = words[new], order[new]
        self.number = np.empty(len(words), np.int32)
        self.number[order] = np.cumsum(new, dtype=np.int32) - 1
        del words, order, new
        self.word_from = t.word_from
        self.word = (hashes % np.uint64(WORDS)).astype(np.int64)
        start, length = t.word_start[first], (t.word_end - t.word_start)[first]
        self.length = length
        self.gram_from = np.cumsum(length) - length
        place = np.arange(length.sum()) - np.repeat(self.gram_from, length)
        left = np.repeat(length, length) - place
        at = place + np.repeat(start, length)
        code = t.data[at].astype(np.uint64)
        for k in (1, 2):  # what lies beyond the word counts as zero
            code = code << np.uint64(8) | np.where(left > k, t.data[np.minimum(at + k, len(t.data) - 1)], 0).astype(np.uint64)
        self.gram = (mixed(code + (place == 0) * BASE) % np.uint64(GRAMS)).astype(np.int32)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers, -1 after the end of a short text; text) of all windows of all texts.

        Windows start STEP words apart; the last one ends with the text.
        """
        size = np.diff(self.word_from)
        count = np.where(size > 0, 1 + np.maximum(0, -(-(size - WINDOW) // STEP)), 0)
        text = np.repeat(np.arange(len(size)), count)
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = np.minimum(nth * STEP, np.maximum(size[text] - WINDOW, 0))
        left, first = size[text] - start, start + self.word_from[text]
        rows = np.full((len(text), WINDOW), -1, np.int32)
        for place in range(WINDOW):
            some = left > place
            rows[some, place] = self.number[first[some] + place]
        return rows, text


class Network:
    def __init__(self, seed: int = 11):
        draw = np.random.default_rng(seed)
        norm = lambda *shape, by=0.3: draw.normal(0, by, shape).astype(f32)
        self.p = {"word": norm(WORDS, DIM), "gram": norm(GRAMS, DIM), "attend": norm(2 * HIDDEN), "out": norm(2 * HIDDEN), "bias": np.zeros(1, f32)}
        for side in "fb":
            self.p |= {f"x{side}": norm(2 * DIM, 3 * HIDDEN), f"h{side}": norm(HIDDEN, 3 * HIDDEN), f"c{side}": np.zeros(3 * HIDDEN, f32)}
        self.sums = {k: np.full_like(v, 1e-8) for k, v in self.p.items()}
        self.prior: float | None = None  # the score of all, where there was nothing to learn

    def inputs(self, lex: Lexicon, some: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors of the given words (default: all), with their grams and the word each gram is of."""
        some = np.arange(len(lex.word)) if some is None else some
        length = lex.length[some]
        owner = np.repeat(np.arange(len(some)), length)
        gram = lex.gram[np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(lex.gram_from[some], length)]
        chars = np.add.reduceat(self.p["gram"][gram], np.cumsum(length) - length, axis=0) / length[:, None] if len(some) else np.zeros((0, DIM), f32)
        return np.concatenate([self.p["word"][lex.word[some]], chars], axis=1).astype(f32), gram, owner

    # -- scoring ---------------------------------------------------------------------------

    def score_windows(self, lex: Lexicon, windows: np.ndarray) -> np.ndarray:
        half = np.repeat(np.array([0.5, 0.5, 1], f32), HIDDEN)  # sigmoid(a) = (1 + tanh(a / 2)) / 2
        gates = {s: np.zeros((len(lex.word) + 1, 3 * HIDDEN), f32) for s in "fb"}
        for i in range(0, len(lex.word), WORDS_HELD):
            x, _, _ = self.inputs(lex, np.arange(i, min(i + WORDS_HELD, len(lex.word))))
            for s, own in gates.items():
                own[i : i + len(x)] = (x @ self.p[f"x{s}"] + self.p[f"c{s}"]) * half
        scores = [self._block(gates, half, windows[i : i + BLOCK]) for i in range(0, len(windows), BLOCK)]
        return np.concatenate(scores) if scores else np.empty(0, f32)

    def _block(self, gates: dict, half: np.ndarray, rows: np.ndarray) -> np.ndarray:
        n, steps = rows.shape
        present = (rows >= 0).astype(f32)
        whole = bool(present.all())
        states = np.empty((steps, n, 2 * HIDDEN), f32)
        for side, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            u, h = self.p[f"h{side}"] * half, np.zeros((n, HIDDEN), f32)
            for t in order:
                g, v = gates[side][rows[:, t]], h @ u
                zr = np.tanh(g[:, : 2 * HIDDEN] + v[:, : 2 * HIDDEN]) * f32(0.5) + f32(0.5)
                cand = np.tanh(g[:, 2 * HIDDEN :] + zr[:, HIDDEN:] * v[:, 2 * HIDDEN :])
                new = cand + zr[:, :HIDDEN] * (h - cand)
                h = new if whole else h + present[:, t, None] * (new - h)
                states[t, :, slice(0, HIDDEN) if side == "f" else slice(HIDDEN, None)] = h
        e = states @ self.p["attend"] if whole else states @ self.p["attend"] + (present.T - 1) * f32(1e9)
        e = np.exp(e - e.max(axis=0))
        logit = (e * (states @ self.p["out"])).sum(axis=0) / e.sum(axis=0) + self.p["bias"][0]
        return 1 / (1 + np.exp(-logit))

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        out = np.full(len(texts), 1 / (1 + np.exp(-float(self.p["bias"][0]))) if len(texts) else 0.0)
        lex = Lexicon(texts)
        windows, text = lex.windows()
        if len(text):
            first = np.flatnonzero(np.diff(text, prepend=-1))
            out[text[first]] = np.maximum.reduceat(self.score_windows(lex, windows), first)
        return out

    # -- training --------------------------------------------------------------------------

    def gradients(self, lex: Lexicon, rows: np.ndarray, labels: np.ndarray) -> tuple[float, dict, dict]:
        """Mean log loss, gradients of the dense parameters, and (rows, gradients) of the two tables."""
        n, steps = rows.shape
        some, at = np.unique(np.maximum(rows, 0), return_inverse=True)
        at = at.reshape(rows.shape)
        present = (rows >= 0).astype(f32)[:, :, None]
        x, gram, owner = self.inputs(lex, some)
        H, p, states, saved = HIDDEN, self.p, np.empty((n, steps, 2 * HIDDEN), f32), {}
        for side, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            gates, h, own = (x @ p[f"x{side}"] + p[f"c{side}"])[at], np.zeros((n, H), f32), {}
            for t in order:
                g, v = gates[:, t], h @ p[f"h{side}"]
                zr = 1 / (1 + np.exp(-(g[:, : 2 * H] + v[:, : 2 * H])))
                z, r = zr[:, :H], zr[:, H:]
                cand = np.tanh(g[:, 2 * H :] + r * v[:, 2 * H :])
                own[t] = (h, z, r, cand, v[:, 2 * H :])
                h = h + present[:, t] * (cand + z * (h - cand) - h)
                states[:, t, slice(0, H) if side == "f" else slice(H, None)] = h
            saved[side] = own
        e = states @ p["attend"] + (present[:, :, 0] - 1) * f32(1e9)
        e = np.exp(e - e.max(axis=1, keepdims=True))
        alpha = e / e.sum(axis=1, keepdims=True)
        pooled = (alpha[:, :, None] * states).sum(axis=1)
        score = 1 / (1 + np.exp(-(pooled @ p["out"] + p["bias"][0])))
        loss = -float(np.mean(labels * np.log(score + 1e-9) + (1 - labels) * np.log(1 - score + 1e-9)))

        d = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "gram")}
        d_logit = ((score - labels) / n).astype(f32)
        d["out"], d["bias"][0] = pooled.T @ d_logit, d_logit.sum()
        d_pooled = d_logit[:, None] * p["out"]
        d_alpha = (states * d_pooled[:, None, :]).sum(axis=2)
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(axis=1, keepdims=True))
        d["attend"] = np.einsum("nt,nth->h", d_e, states)
        d_states = alpha[:, :, None] * d_pooled[:, None, :] + d_e[:, :, None] * p["attend"]
        d_x = np.zeros_like(x)
        for side, order in (("f", range(steps - 1, -1, -1)), ("b", range(steps))):
            d_gates, d_h, u = np.zeros((n, steps, 3 * H), f32), np.zeros((n, H), f32), p[f"h{side}"]
            for t in order:
                before, z, r, cand, v = saved[side][t]
                d_h = d_h + d_states[:, t, slice(0, H) if side == "f" else slice(H, None)]
                d_new = d_h * present[:, t]
                d_cand = d_new * (1 - z) * (1 - cand * cand)
                d_z = d_new * (before - cand) * z * (1 - z)
                d_r = d_cand * v * r * (1 - r)
                d_gates[:, t] = np.concatenate([d_z, d_r, d_cand], axis=1)
                d_v = np.concatenate([d_z, d_r, d_cand * r], axis=1)
                d[f"h{side}"] += before.T @ d_v
                d_h = d_h - d_new + d_new * z + d_v @ u.T
            by_word = np.zeros((len(some), 3 * H), f32)
            np.add.at(by_word, at.ravel(), d_gates.reshape(-1, 3 * H))
            d[f"x{side}"], d[f"c{side}"] = x.T @ by_word, by_word.sum(axis=0)
            d_x += by_word @ p[f"x{side}"].T
        words, which = np.unique(lex.word[some], return_inverse=True)
        d_word = np.zeros((len(words), DIM), f32)
        np.add.at(d_word, which, d_x[:, :DIM])
        grams, which = np.unique(gram, return_inverse=True)
        d_gram = np.zeros((len(grams), DIM), f32)
        np.add.at(d_gram, which, (d_x[:, DIM:] / lex.length[some][:, None])[owner])
        return loss, d, {"word": (words, d_word), "gram": (grams, d_gram)}

    def step(self, lex: Lexicon, rows: np.ndarray, labels: np.ndarray) -> float:
        loss, dense, tables = self.gradients(lex, rows, labels)
        for k, g in dense.items():
            self.sums[k] += g * g
            self.p[k] -= RATE * g / np.sqrt(self.sums[k])
        for k, (at, g) in tables.items():
            self.sums[k][at] += g * g
            self.p[k][at] -= RATE * g / np.sqrt(self.sums[k][at])
        return loss


def suspicion(lex: Lexicon, labels: np.ndarray) -> np.ndarray:
    """Log odds of each distinct word by the share of toxic and other texts that have it."""
    text = np.repeat(np.arange(len(labels)), np.diff(lex.word_from))
    pairs = np.unique(lex.number.astype(np.int64) * len(labels) + text)
    word, text = pairs // len(labels), pairs % len(labels)
    ones = np.bincount(word, labels[text], len(lex.word))
    zeros = np.bincount(word, 1 - labels[text], len(lex.word))
    return np.log((ones + 0.5) / (labels.sum() + 1)) - np.log((zeros + 0.5) / ((1 - labels).sum() + 1)) - (ones < 3) * 2.0


def worst(value: np.ndarray, text: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` highest windows of each text."""
    order = np.lexsort((-value, text))
    place = np.arange(len(order)) - np.searchsorted(text[order], text[order])
    return order[place < most]


def train(sample: list[tuple[str, int]], seed: int = 5) -> Network:
    """A network for (text, label) pairs. Without two classes it gives all the smoothed prior."""
    labels = np.array([int(label == 1) for _, label in sample], np.int64)
    net, draw = Network(), np.random.default_rng(seed)
    ones = int(labels.sum())
    texts = [t.encode("utf-8", "replace") for t, _ in sample]
    lex = Lexicon(texts) if texts else None
    if ones in (0, len(labels)) or not len(lex.number):
        net.prior = (ones + 1) / (len(labels) + 2)
        return net
    windows, text = lex.windows()
    toxic = labels[text] == 1
    for turn in range(ROUNDS):
        if turn == 0:
            odds = np.append(suspicion(lex, labels), -9.0).astype(f32)
            value = odds[windows].max(axis=1)
        else:
            value = net.score_windows(lex, windows)
        clean = np.flatnonzero(~toxic)
        bad = np.flatnonzero(toxic)
        bad = bad[worst(value[bad], text[bad], 2)]
        bad = bad[value[bad] >= np.median(value[bad]) * 0.5] if turn == 0 else bad
        hard = clean[worst(value[clean], text[clean], 1 + turn)]
        some = draw.choice(clean, min(len(clean), 2 * len(bad)), replace=False)
        chosen = np.concatenate([bad, hard, some])
        for _ in range(EPOCHS):
            for rows in np.array_split(draw.permutation(chosen), max(1, len(chosen) // BATCH)):
                net.step(lex, windows[rows], toxic[rows].astype(f32))
    return net


def learnt(sample: list[tuple[str, int]]) -> Network:
    """A trained network without what only training needs."""
    net = train(sample)
    net.sums = {}
    return net


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> Network:
    labels = labels.select("doc_id", F.col("toxic").alias("label")).where(F.col("label").isin(0, 1))
    return trained(sample_table(docs.select("doc_id", "text"), labels, fold(F.col("doc_id"), FOLDS) != HELD, per_class, seed=10), learnt)


def scorer(spark, net: Network) -> Callable[[Column], Column]:
    held = spark.sparkContext.broadcast(net)  # WORDS + GRAMS vectors, whatever the input

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = [held.value.score(part) for part in chunks(texts)]
            yield pd.Series(np.concatenate(found).astype(np.float64) if found else np.empty(0))

    return run


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text).

    The network learns from at most SAMPLE documents of each label outside the held-out fold;
    labels other than 0 and 1 are ignored. With one class alone, or none, the score is the
    smoothed share of label 1 for all. A null text, or one without words, has the score of
    the network's bias. All windows of a text are scored, however long it is. Repeated rows
    are scored each; an empty table gives an empty table; other columns are not read.
    """
    net = fit(docs, labels)
    found = docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), scorer(docs.sparkSession, net)(F.col("text")).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_civil(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not predicted toxic.

    Every row is judged by its own text and as ``toxicity`` judges it: null texts and those
    without words by the score they have there, repeated rows each, rows without an id like
    any others. Without two classes of labels all rows have one score.
    """
    return docs.where(scorer(docs.sparkSession, fit(docs, labels))(F.col("text")) < threshold)
