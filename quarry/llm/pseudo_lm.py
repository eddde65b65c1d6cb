"""Document scores by masked pseudo-likelihood.

Every token is masked in turn and predicted by a window network from the SIDE words before and
after it. A word's probability there is its share of the corpus, times the exponential of how
well its output vector fits the window, over the same summed for all words: a softmax whose
bias is the log count. Words have input and output vectors by their hash; counts are every
word's own. The sum over all words is a sampled one, as large vocabularies need: the heaviest
vectors with their whole mass, and one vector of each equal share of the rest.

The network is trained in numpy on every token. Texts are dealt to shards of about SHARD bytes
by a hash of id and text and read in the order of that hash; each shard trains from the same
start, and the shards' parameters are averaged by their tokens. So the result depends on the
rows alone, not on how they are partitioned; what is counted and what is learnt from grow with
the corpus, and no place ever holds either whole: texts are scored in blocks, whose distinct
words are joined with the counts, each word once a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialize
from .features import NOT_WORD, Texts

SIDE, HIDDEN = 3, 16
#: Output and input vectors; words are dealt to them by their hash. The last input is what lies beyond a text.
OUT_BITS, IN_BITS = 14, 11
OUTS, INS = 1 << OUT_BITS, (1 << IN_BITS) + 1
#: Words that a training step is held against, vectors with their whole mass and shares of the rest in scoring.
NOISE, HEAVY, SHARES = 64, 64, 64
#: A batch is a sixteenth of the tokens learnt from so far, within these bounds.
BATCH_LEAST, BATCH_MOST, RATE, SMALL = 64, 8192, 0.05, 10.0
#: Bytes of text in a shard, and shards (or averages of them) that are averaged together.
SHARD, TOGETHER = 24_000_000, 64
#: Distinct words that a task sums up before it passes them on.
HELD = 1_000_000
#: Tokens and texts whose words are looked up together.
BLOCK = 1_000_000

f32 = np.float32
SHAPES = {"context": (2 * SIDE * INS, HIDDEN), "inner": (HIDDEN,), "out": (OUTS, HIDDEN)}
PLACES = [p for p in range(-SIDE, SIDE + 1) if p]
PIECES = 16


def tokens(texts: list[bytes]) -> tuple[Texts, np.ndarray]:
    """The texts, and their words' hashes."""
    t = Texts(texts, NOT_WORD, lower=True)
    return t, t.words().view(np.int64)


def outs(words: np.ndarray) -> np.ndarray:
    """The output vector of each word."""
    return (words >> np.int64(20)).astype(np.int32) & np.int32(OUTS - 1)


def out_of(word: Column) -> Column:
    return F.shiftright(word, 20).bitwiseAND(F.lit(OUTS - 1).cast("long")).cast("int")


def contexts(t: Texts, words: np.ndarray) -> np.ndarray:
    """Input vectors of the words around each word, by place; the text's end is an input of its own."""
    last = INS - 1
    own = (words >> np.int64(40)).astype(np.int32) & np.int32(last - 1)
    edge = np.full(SIDE, last, np.int32)
    padded, doc = np.concatenate([edge, own, edge]), np.concatenate([edge * 0 - 1, t.word_doc.astype(np.int32), edge * 0 - 1])
    n = len(words)
    rows = [np.where(doc[SIDE + p : SIDE + p + n] == doc[SIDE : SIDE + n], padded[SIDE + p : SIDE + p + n], last) + np.int32(i * INS) for i, p in enumerate(PLACES)]
    return np.stack(rows)


class Network:
    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def fresh(cls, seed: int = 2) -> Network:
        draw = np.random.default_rng(seed)
        return cls({k: draw.normal(0, 0.1, shape).astype(f32) for k, shape in SHAPES.items()})

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        edges = np.cumsum([0, *[int(np.prod(s)) for s in SHAPES.values()]])
        return cls({k: flat[a:b].reshape(shape).astype(f32) for (k, shape), a, b in zip(SHAPES.items(), edges, edges[1:], strict=False)})

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in SHAPES])

    def hidden(self, around: np.ndarray) -> np.ndarray:
        total = self.p["inner"] + self.p["context"][around[0]]
        for at in around[1:]:
            total += self.p["context"][at]
        return np.tanh(total, out=total)

    def fit(self, around: np.ndarray, out: np.ndarray, some: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """How far the log-probability of each word, given its surroundings, lies above that of its count alone."""
        fits = np.empty(len(out))
        held, log_weight = np.ascontiguousarray(self.p["out"][some].T), np.log(weight).astype(f32)
        for i in range(0, len(out), 4096):
            h = self.hidden(around[:, i : i + 4096])
            logit = h @ held
            logit += log_weight
            np.clip(logit, -60, 60, out=logit)
            mine = np.einsum("ij,ij->i", h, self.p["out"][out[i : i + 4096]])
            fits[i : i + 4096] = np.clip(mine, -60, 60) - np.log(np.exp(logit, out=logit).sum(axis=1))
        return fits

    def gradients(self, around: np.ndarray, out: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the summed loss: by hidden sum (a row a token), by the tokens' output vectors, by the noise's."""
        h, own, other = self.hidden(around), self.p["out"][out], self.p["out"][noise]
        prob = h @ other.T
        np.clip(prob, -60, 60, out=prob)
        np.exp(prob, out=prob)
        prob /= prob.sum(axis=1, keepdims=True)
        back = prob @ other - own
        return back * (1 - h * h), -h, prob.T @ h

    def learn(self, around: np.ndarray, out: np.ndarray, noise: np.ndarray, squares: dict[str, np.ndarray]) -> None:
        back, d_own, d_noise = self.gradients(around, out, noise)
        at, each, size = around.ravel(), np.tile(back.T, len(around)), len(self.p["context"])
        g = np.stack([np.bincount(at, unit, size) for unit in each], axis=1).astype(f32)
        self._move("context", slice(None), g, squares)
        self._move("inner", slice(None), back.sum(axis=0), squares)
        rows = np.concatenate([out, noise])
        order = np.argsort(rows, kind="stable")
        first = np.flatnonzero(np.diff(rows[order], prepend=-1))
        g = np.add.reduceat(np.concatenate([d_own, d_noise])[order], first, axis=0)
        self._move("out", rows[order[first]], g, squares)

    def _move(self, name: str, at: slice | np.ndarray, g: np.ndarray, squares: dict[str, np.ndarray]) -> None:
        square = squares[name][at] + g * g
        squares[name][at] = square
        self.p[name][at] -= RATE * g / np.sqrt(square)


class Shard:
    """A network that learns from texts in their order, once from every token."""

    def __init__(self, number: int):
        self.number, self.seen = number, 0
        self.net, self.draw = Network.fresh(), np.random.default_rng(5)
        self.squares = {k: np.full(shape, SMALL, f32) for k, shape in SHAPES.items()}

    def learn(self, t: Texts, words: np.ndarray) -> None:
        around, out, at = contexts(t, words), outs(words), 0
        while at < len(words):
            size = min(max(self.seen // 16, BATCH_LEAST), BATCH_MOST)
            own = slice(at, at + size)
            # words drawn by place are drawn by frequency
            self.net.learn(around[:, own], out[own], out[self.draw.integers(len(out), size=NOISE)], self.squares)
            self.seen += len(out[own])
            at += size

    def frame(self) -> pd.DataFrame:
        parts = np.array_split(self.net.flat(), PIECES)
        return pd.DataFrame({"shard": self.number, "tokens": float(self.seen), "piece": np.arange(PIECES, dtype=np.int32), "values": [p.tobytes() for p in parts]})


def _shaped(frame: pd.DataFrame, columns: list[str]) -> pd.DataFrame:
    """With nulls in the columns that it lacks."""
    return frame.assign(**{c: None for c in columns if c not in frame})[columns]


def merged(parts: list[np.ndarray]) -> np.ndarray:
    """Distinct words and their summed counts."""
    rows = np.concatenate(parts, axis=1)
    order = np.argsort(rows[0], kind="stable")
    rows = rows[:, order]
    first = np.flatnonzero(np.append(True, rows[0, 1:] != rows[0, :-1])) if rows.shape[1] else np.empty(0, np.int64)
    return np.stack([rows[0, first], np.add.reduceat(rows[1], first) if len(first) else rows[1]])


LEARNT = "word long, n long, shard long, tokens double, piece int, values binary"
_learnt = [c.split()[0] for c in LEARNT.split(", ")]


def learnt(docs: DataFrame) -> DataFrame:
    """LEARNT: rows of words with counts, which tasks sum up first, and rows of shards with parameters."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).collect()[0][0]
    shards = -(-size // SHARD) or 1
    mark = F.xxhash64("text", F.col("doc_id").cast("string"))
    dealt = docs.where(F.length("text") > 0).select(F.pmod(mark, F.lit(shards)).alias("shard"), mark.alias("mark"), "text")
    dealt = dealt.repartitionById(int(shards), F.col("shard").cast("int")).sortWithinPartitions("shard", "mark").select("shard", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, held = [np.empty((2, 0), np.int64)], 0
        shard: Shard | None = None
        waiting: list[str] = []

        def counted(rows: np.ndarray) -> pd.DataFrame:
            return _shaped(pd.DataFrame({"word": rows[0], "n": rows[1]}), _learnt)

        def taken() -> None:
            """The waiting texts, about a megabyte of a shard, learnt and counted."""
            nonlocal held
            for part in chunks(waiting):
                t, words = tokens(part)
                if len(words):
                    shard.learn(t, words)
                    parts.append(merged([np.stack([words, np.ones_like(words)])]))
                    held += parts[-1].shape[1]
            waiting.clear()

        size = 0
        for batch in batches:
            for number, text in zip(batch["shard"], batch["text"], strict=True):
                if shard is None or number != shard.number:
                    if shard is not None:
                        taken()
                        yield _shaped(shard.frame(), _learnt)
                    shard, size = Shard(number), 0
                waiting.append(text)
                size += len(text)
                if size >= 1 << 20:
                    taken()
                    size = 0
                if held > HELD:
                    parts = [merged(parts)]
                    held = parts[0].shape[1]
                    if held > HELD // 2:
                        yield counted(parts.pop())
                        parts, held = [np.empty((2, 0), np.int64)], 0
        if shard is not None:
            taken()
            yield _shaped(shard.frame(), _learnt)
        yield counted(merged(parts))

    return dealt.mapInPandas(run, LEARNT)


def averaged(shards: DataFrame) -> Network:
    """The shards' mean, weighted by tokens; TOGETHER of them are averaged in one task, and again the averages."""

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shard")
        weight = rows["tokens"].to_numpy()
        total = sum(w * np.frombuffer(v, f32).astype(float) for w, v in zip(weight, rows["values"], strict=True)) / max(weight.sum(), 1)
        return pd.DataFrame({"shard": rows["shard"].iloc[:1] // TOGETHER, "tokens": [weight.sum()], "piece": rows["piece"].iloc[:1], "values": [total.astype(f32).tobytes()]})

    highest = shards.agg(F.max("shard")).collect()[0][0]
    if highest is None:
        return Network.fresh()
    while True:
        group = F.expr(f"shard div {TOGETHER}").alias("group")
        shards = shards.groupBy(group, "piece").applyInPandas(mean, "shard long, tokens double, piece int, values binary")
        highest //= TOGETHER
        if not highest:
            break
    pieces = sorted(shards.collect(), key=lambda r: r["piece"])  # PIECES of one network
    return Network.of(np.concatenate([np.frombuffer(r["values"], f32) for r in pieces]))


@dataclass
class Corpus:
    """Of a corpus: its tokens, and the output vectors that stand for all in the sum over all words."""

    total: int
    some: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, counts: DataFrame) -> Corpus:
        rows = counts.groupBy(out_of(F.col("word")).alias("out")).agg(F.sum("n").alias("n")).collect()  # at most OUTS
        rows = np.array(sorted((r["out"], r["n"]) for r in rows), np.int64).reshape(-1, 2)
        total = int(rows[:, 1].sum())
        if not total:
            return cls(0, np.zeros(1, np.int32), np.ones(1))
        order = np.argsort(-rows[:, 1], kind="stable")
        most = HEAVY if len(order) > HEAVY + SHARES else len(order)
        heavy, rest = order[:most], np.sort(order[most:])
        some, weight = rows[heavy, 0], rows[heavy, 1].astype(float)
        if len(rest):
            mass = np.cumsum(rows[rest, 1])
            picked = rest[np.searchsorted(mass, (np.arange(SHARES) + 0.5) * mass[-1] / SHARES)]
            some, weight = np.append(some, rows[picked, 0]), np.append(weight, np.full(SHARES, mass[-1] / SHARES))
        return cls(total, some.astype(np.int32), weight / total)


PART = "block long, place int, doc_id string, n_tokens long, log_prob double, at binary, word long, number int"
RESULT = "doc_id string, n_tokens long, log_prob double, mean_log_prob double"
_part = [c.split()[0] for c in PART.split(", ")]


class Block:
    """Texts whose words are looked up together."""

    def __init__(self, number: int):
        self.number, self.size, self.count = number, 0, 0
        self.docs: list[pd.DataFrame] = []
        self.words: list[np.ndarray] = []

    def add(self, ids: pd.Series, texts: list[bytes], corpus: Corpus, net: Network) -> None:
        t, words = tokens(texts)
        logs = net.fit(contexts(t, words), outs(words), corpus.some, corpus.weight) - np.log(max(corpus.total, 1))
        place = np.arange(self.count, self.count + len(texts))
        self.docs.append(pd.DataFrame({"place": place, "doc_id": ids.to_numpy(), "n_tokens": np.diff(t.word_from), "log_prob": np.bincount(t.word_doc, logs, len(texts))}))
        self.words.append(words)
        self.count += len(texts)
        self.size += len(words) + len(texts)

    def frames(self) -> Iterator[pd.DataFrame]:
        """A row of each text, with its words by number, and a row of each distinct word."""
        docs = pd.concat(self.docs, ignore_index=True)
        distinct, number = np.unique(np.concatenate(self.words), return_inverse=True)
        ends = 4 * np.cumsum(docs["n_tokens"].to_numpy())
        raw = number.astype(np.int32).tobytes()
        docs["at"] = [raw[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
        yield _shaped(docs.assign(block=self.number), _part)
        if len(distinct):
            words = pd.DataFrame({"block": self.number, "word": distinct, "number": np.arange(len(distinct), dtype=np.int32)})
            yield _shaped(words, _part)


def summed(frame: pd.DataFrame) -> pd.DataFrame:
    """A block's texts, with the logarithms of their words' counts."""
    docs, words = frame[frame["place"].notna()], frame[frame["number"].notna()]
    log_count = np.zeros(len(words))
    log_count[words["number"].to_numpy(np.int64)] = np.log(words["n"].to_numpy(float))
    n = docs["n_tokens"].to_numpy(np.int64)
    at = np.frombuffer(b"".join(docs["at"]), np.int32)
    total = docs["log_prob"].to_numpy(float) + np.bincount(np.repeat(np.arange(len(docs)), n), log_count[at], len(docs))
    mean = pd.Series(np.where(n > 0, total / np.maximum(n, 1), 0.0)).astype("Float64").mask(n == 0)
    return pd.DataFrame({"doc_id": docs["doc_id"].array, "n_tokens": n, "log_prob": total, "mean_log_prob": mean.array})


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_prob, mean_log_prob of every row of ``docs`` (doc_id, text).

    Tokens are words with A-Z lower-cased. log_prob is the sum over all tokens of a text, however
    long, of their log-probability given the words around them; mean_log_prob is that by token.
    A text that is null, empty or without words has 0 tokens, log_prob 0 and a null mean. Rows
    that repeat are counted and scored each, and meet in one shard; words that share a vector
    are told apart by their counts; an empty table gives an empty table; other columns are not
    read. However the rows are partitioned, the scores are the same but for rounding.
    """
    found = materialize(learnt(docs), "learnt")
    counts = materialize(found.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").alias("n")), "words")
    net = averaged(found.where(F.col("piece").isNotNull()).select("shard", "tokens", "piece", "values"))
    held = docs.sparkSession.sparkContext.broadcast((Corpus.of(counts), net.p))  # a network of fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, params = held.value
        net = Network(params)
        block = Block(TaskContext.get().partitionId() << 32)
        for batch in batches:
            done = 0
            for part in chunks(batch["text"]):
                block.add(batch["doc_id"].iloc[done : done + len(part)], part, own, net)
                done += len(part)
                if block.size >= BLOCK:
                    yield from block.frames()
                    block = Block(block.number + 1)
        if block.count:
            yield from block.frames()

    # ids as text, since pandas would turn integers with nulls into floating point
    parts = materialize(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, PART), "parts")
    words = parts.where(F.col("word").isNotNull()).select("block", "word", "number").join(counts, "word").select("block", "number", "n")
    texts = parts.where(F.col("place").isNotNull()).select("block", "place", "doc_id", "n_tokens", "log_prob", "at")
    scored = texts.unionByName(words, allowMissingColumns=True).groupBy("block").applyInPandas(summed, RESULT)
    return scored.withColumn("doc_id", F.col("doc_id").cast("long"))
