"""Vectors of texts: what a model has to offer, and a model-free one."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import CAMEL, TOKEN, content_hash
from .maintain import reused_vectors

_camel, _token = re.compile(CAMEL), re.compile(TOKEN)


class Embedder(Protocol):
    """Unit vectors of texts. An embedder is sent to workers, so a model is loaded on first use there."""

    name: str

    def passages(self, texts: list[str]) -> np.ndarray: ...

    def question(self, text: str) -> np.ndarray: ...

    def offsets(self, text: str) -> list[int]:
        """Where each token of a text begins."""
        ...


def _units(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return (rows / np.where(norm > 0, norm, 1)).astype(np.float32)


class HashingEmbedder:
    """Signed sums of hashed identifier tokens, normalized: needs no model, and equal texts are equal."""

    def __init__(self, dim: int = 64):
        self.dim, self.name = dim, f"hashing-{dim}"

    def passages(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, text in enumerate(texts):
            for token in _token.findall(_camel.sub(r"\1 \2", text).lower()):
                h = zlib.crc32(token.encode())
                out[i, h % self.dim] += 1 if h >> 16 & 1 else -1
        return _units(out)

    def question(self, text: str) -> np.ndarray:
        return self.passages([text])[0]

    def offsets(self, text: str) -> list[int]:
        from .chunking import word_starts

        return word_starts(text)


# Tokens that a model reads of a text, and the prefixes of models whose name has e5.
MODEL_TOKENS = 512
E5_PREFIXES = {"question": "query: ", "passage": "passage: "}


class OnnxEmbedder:
    """A sentence model in a folder: ``model.onnx``, ``tokenizer.json`` and, if it pools by its first
    token, ``pooling.json``. Only the folder is sent to workers; each process loads it once. Vectors
    are the mean of the tokens' that are no padding, or the first token's, at unit length."""

    def __init__(self, folder: str, name: str | None = None):
        self.folder = os.path.abspath(folder)
        self.name = name or os.path.basename(self.folder)
        self.prefixes = E5_PREFIXES if "e5" in self.name.lower() else {"question": "", "passage": ""}

    def __getstate__(self) -> dict:
        return {"folder": self.folder, "name": self.name, "prefixes": self.prefixes}

    def _load(self) -> None:
        if "session" in self.__dict__:
            return
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the task has one core
        import onnxruntime
        from tokenizers import Tokenizer

        own = os.path.join(self.folder, "tokenizer.json")
        self.plain, self.tokens = Tokenizer.from_file(own), Tokenizer.from_file(own)
        self.tokens.enable_truncation(MODEL_TOKENS)
        if self.tokens.padding is None:
            self.tokens.enable_padding(pad_id=self.tokens.token_to_id("<pad>") or 0)
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1
        pooling = os.path.join(self.folder, "pooling.json")
        self.first_token = False
        if os.path.exists(pooling):
            with open(pooling) as file:
                self.first_token = bool(json.load(file).get("pooling_mode_cls_token"))
        self.session = onnxruntime.InferenceSession(os.path.join(self.folder, "model.onnx"), options, providers=["CPUExecutionProvider"])

    def _vectors(self, kind: str, texts: list[str]) -> np.ndarray:
        self._load()
        read = self.tokens.encode_batch([self.prefixes[kind] + t for t in texts])
        given = {"input_ids": np.array([r.ids for r in read], np.int64), "attention_mask": np.array([r.attention_mask for r in read], np.int64)}
        given["token_type_ids"] = np.zeros_like(given["input_ids"])
        states = self.session.run(None, {i.name: given[i.name] for i in self.session.get_inputs()})[0]
        if self.first_token:
            return _units(states[:, 0])
        present = given["attention_mask"][:, :, None]
        return _units((states * present).sum(axis=1) / np.maximum(present.sum(axis=1), 1))

    def passages(self, texts: list[str]) -> np.ndarray:
        return self._vectors("passage", texts)

    def question(self, text: str) -> np.ndarray:
        return self._vectors("question", [text])[0]

    def offsets(self, text: str) -> list[int]:
        self._load()
        return [begin for begin, _ in self.plain.encode(text, add_special_tokens=False).offsets]


def embedded(chunks: DataFrame, embedder: Embedder, cache: DataFrame | None = None, batch: int = 8) -> DataFrame:
    """``chunks`` with hash and vector. Vectors of known hashes are joined, others are computed,
    each distinct text once. Batches are of similar length, as models pad to the longest."""
    hashed = chunks.withColumn("hash", content_hash(F.lit(embedder.name), F.col("text")))
    known = cache.select("hash", "vector").dropDuplicates(["hash"]) if cache is not None else None
    new = hashed.select("hash", "text").dropDuplicates(["hash"])
    if known is not None:
        new = new.join(known, "hash", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows = rows.iloc[rows["text"].str.len().argsort(kind="stable")]
            parts = [embedder.passages(rows["text"].iloc[i : i + batch].tolist()) for i in range(0, len(rows), batch)]
            yield pd.DataFrame({"hash": rows["hash"].to_numpy(), "vector": [v for p in parts for v in p.astype(np.float32)]})

    computed = new.mapInPandas(run, "hash string, vector array<float>")
    return reused_vectors(hashed, computed if known is None else known.unionByName(computed))
