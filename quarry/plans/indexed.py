"""Stored indexes of the driver's tables, built once a session and asked many times."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from ..operators import stored
from ..sources.store import Store
from . import corpora

_built: dict[tuple[str, str, str], Store] = {}


def _home(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; an own one only in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="indexes-")
    return path.rstrip("/")


def build(store: Store, chunks: DataFrame) -> None:
    """Chunks first, then what is made of them, each from what is written before it."""
    steps = {
        "chunks": lambda: chunks,
        "postings": lambda: stored.postings(store.read("chunks")),
        "frequencies": lambda: stored.frequencies(store.read("postings")),
        "sizes": lambda: stored.sizes(*[store.read(t) for t in ("chunks", "postings", "frequencies")]),
    }
    for name, table in steps.items():
        store.write({name: table()}, stored.SORTED, add=True)


def indexes(spark: SparkSession, sf_dir: str, kind: str = "documents") -> stored.StoredIndexes:
    """Indexes of all documents as chunks, or (``hybrid``) of those that have a vector."""
    key = spark.sparkContext.applicationId, sf_dir, kind
    if key not in _built:
        name = "-".join([kind, key[0], str(len(_built))])
        _built[key] = Store(spark, f"{_home(spark)}/stored-{name}")
        build(_built[key], {"documents": corpora.chunks, "hybrid": corpora.hybrid_chunks}[kind](spark, sf_dir))
    store = _built[key]
    return stored.StoredIndexes(*[store.read(t) for t in ("chunks", "postings", "frequencies", "sizes")])
