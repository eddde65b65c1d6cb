"""A library of indexes: building, changing and searching them, with its catalog."""

from __future__ import annotations

import hashlib
import json
import os
import time
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import SCHEMA as FILES
from ..sources.files import FileSource, list_files, subfolders
from ..sources.store import Store
from . import catalog, search, stored
from .chunking import chunk_files
from .embed import Embedder, HashingEmbedder, embedded
from .maintain import appended, files_per_extension, manifest_diff, retained, to_parse

CHUNKS = "index_id string, row_id long, file string, start_line int, end_line int, text string, hash string, vector array<float>"
#: 2: sizes have the sums of their words' weights.
FORMAT = 2


def storage_key(directory: str) -> str:
    """As ``quarry.functions.text.storage_key``, of one directory."""
    return f"{hashlib.sha256(directory.encode()).hexdigest()[:12]}-{directory.rsplit('/', 1)[-1]}"


@dataclass
class Library:
    """Indexes and catalog below ``home``, a folder that driver and executors share."""

    spark: SparkSession
    home: str
    embedder: Embedder = field(default_factory=HashingEmbedder)

    def __post_init__(self):
        self.spark.dataSource.register(FileSource)
        self._catalog = Store(self.spark, f"{self.home}/catalog")

    # -- catalog ---------------------------------------------------------------------------

    def entries(self) -> DataFrame:
        found = self._catalog.read("entries")
        return found if found is not None else self.spark.createDataFrame([], catalog.SCHEMA)

    def _commit(self, entries: DataFrame) -> None:
        self._catalog.write({"entries": entries})

    def entry(self, directory: str) -> dict | None:
        rows = self.entries().where(F.col("directory") == directory).limit(1).collect()
        return rows[0].asDict() if rows else None

    def store(self, directory: str) -> Store:
        return Store(self.spark, f"{self.home}/indexes/{storage_key(directory)}")

    def _about(self, directories: list[str]) -> dict[str, tuple[str, int]]:
        """Model and format of the indexes that are built, read at once."""
        paths = {d: p for d in directories if (p := self.store(d).location("about"))}
        if not paths:
            return {}
        rows = self.spark.read.schema("model string, format int").parquet(*paths.values()).select("model", "format", F.col("_metadata.file_path").alias("path")).collect()
        own = {unquote(r["path"]).split("/indexes/")[-1].split("/")[0]: (r["model"], r["format"]) for r in rows}
        return {d: own[storage_key(d)] for d in paths if storage_key(d) in own}

    def stale(self, directories: list[str] | None = None) -> list[str]:
        """Directories of the catalog whose tables are of an older format; they have to be built again."""
        entries = self.entries()
        asked = [r[0] for r in entries.select("directory").collect()] if directories is None else directories
        rows = [(d, f != FORMAT, f == FORMAT) for d, (_, f) in self._about(asked).items()]
        formats = self.spark.createDataFrame(rows, "directory string, has_old boolean, has_new boolean")
        return sorted(r[0] for r in catalog.stale(entries, formats).collect())

    def ancestor(self, path: str) -> str | None:
        """The nearest directory of the catalog at or above a path."""
        asked = self.spark.createDataFrame([(os.path.abspath(path),)], "path string")
        return catalog.nearest_ancestor(asked, self.entries()).collect()[0]["ancestor"]

    def _now(self) -> str:
        return datetime.now(timezone.utc).isoformat()

    def _register(self, directory: str, **values) -> None:
        self._commit(catalog.register(self.entries(), directory, self._now(), self.embedder.name, **values))

    def add(self, directory: str, tags: list[str] | None = None, description: str | None = None) -> None:
        """Register without building."""
        directory = os.path.abspath(directory)
        self._register(directory, description=description)
        if tags is not None:
            self.tag(directory, tags)

    def tag(self, directory: str, tags: list[str]) -> None:
        """Replace an entry's tags; its children get them with their folder's own."""
        self._commit(catalog.tag_children(catalog.set_tags(self.entries(), directory, tags), directory))

    def describe(self, directory: str, description: str) -> None:
        self._commit(catalog.set_description(self.entries(), directory, description))

    def remove(self, directory: str) -> bool:
        """Drop an entry, its children and their data; False if there is none."""
        entries = self.entries()
        gone = [r[0] for r in catalog.cascade(entries, directory).collect()]
        if self.entry(directory) is None:
            return False
        self._commit(catalog.unregister(entries, directory))
        for d in gone:
            self.store(d).drop()
        return True

    def split(self, directory: str, skip: list[str] | None) -> list[str]:
        """Split an index by subfolders, or (None) make it one again; gives the indexes that went."""
        if self.entry(directory) is None:
            raise KeyError(directory)
        gone = [r[0] for r in catalog.removed_by_split(self.entries(), directory, skip).collect()]
        self._commit(catalog.set_split(self.entries(), directory, skip))
        for d in gone:
            self.store(d).drop()
        return gone

    # -- building --------------------------------------------------------------------------

    def _files(self, directory: str, content: bool, **options: str) -> DataFrame:
        return self.spark.read.format("source_files").options(root=directory, content=str(content).lower(), **options).schema(FILES).load()

    def build(self, directory: str, force: bool = False, split: bool | None = None, tags: list[str] | None = None, exclude: list[str] | None = None) -> dict:
        """Bring an index up to date. ``split`` None: as it was; ``exclude`` None: as before, []: none."""
        directory = os.path.abspath(directory)
        if not os.path.isdir(directory):
            raise NotADirectoryError(directory)
        entry = self.entry(directory) or {}
        exclude = (entry.get("exclude") or []) if exclude is None else exclude
        tags = entry.get("tags") if tags is None else tags
        if not (entry.get("split") if split is None else split):
            done = self._build_one(directory, force, False, exclude)
            self._register(directory, exclude=exclude)
        else:
            done = self._build_one(directory, force, True, exclude)
            children = []
            for sub in subfolders(directory, entry.get("skip"), exclude):
                if self._build_one(sub, force, False, exclude)["files"]:
                    children.append(sub)
                    self._register(sub)
                else:
                    self.store(sub).drop()
            stale = [c for c in entry.get("children") or [] if c not in children]
            for c in stale:
                self.remove(c)
            self._register(directory, children=children, split=True, exclude=exclude)
            done |= {"children": children, "dropped": stale}
        if tags:
            self.tag(directory, tags)
        return done

    def _build_one(self, directory: str, force: bool, root_only: bool, exclude: list[str]) -> dict:
        """One index: list, compare, parse what is new, reuse vectors, append, commit."""
        began, store = time.time(), self.store(directory)
        paths, ignored = list_files(directory, root_only, exclude)
        current = self._files(directory, False, paths=json.dumps(paths)).select("path", "mtime", "size")
        known, old = store.read("manifest"), store.read("chunks")
        model = store.read("about")
        same_model = model is not None and tuple(model.select("model", "format").collect()[0]) == (self.embedder.name, FORMAT)
        if known is None or old is None or not same_model:
            known, old = self.spark.createDataFrame([], "path string, mtime double, size long"), self.spark.createDataFrame([], CHUNKS)
        diff = manifest_diff(current, known if not force else known.limit(0)).cache()
        counts = {r["status"]: r["count"] for r in diff.groupBy("status").count().collect()}
        if same_model and not force and not set(counts) - {"same"}:
            diff.unpersist()
            return {"files": len(paths), "skipped": True, "ignored": ignored, "seconds": time.time() - began}
        kept = retained(old, diff)
        parse = [r["path"] for r in to_parse(diff).orderBy("path").collect()]  # of one folder's listing, which the driver made
        fresh = chunk_files(self._files(directory, True, paths=json.dumps(parse)).withColumn("index_id", F.lit(directory)), self.embedder.offsets)
        fresh = embedded(fresh, self.embedder, old if same_model else None).withColumn("row_id", F.lit(0).cast("long"))
        about = self.spark.createDataFrame([(self.embedder.name, FORMAT)], "model string, format int")
        # each written before the next is made of it: files that are parsed once, rows that are fixed, and texts that are tokenized once
        scratch, columns = Store(self.spark, f"{store.path}-next"), [c.split()[0] for c in CHUNKS.split(", ")]
        scratch.write({"fresh": fresh.select(columns)})
        scratch.write({"chunks": appended(kept.select(columns), scratch.read("fresh"))}, add=True)
        rows = scratch.read("chunks")
        # sorted by term, so that a question reads the pages of its terms
        scratch.write({"postings": stored.postings(rows)}, stored.SORTED, add=True)
        postings = scratch.read("postings")
        scratch.write({"frequencies": stored.frequencies(postings)}, stored.SORTED, add=True)
        frequencies = scratch.read("frequencies")
        tables = {"chunks": rows, "postings": postings, "frequencies": frequencies, "sizes": stored.sizes(rows, postings, frequencies)}
        store.write({**tables, "manifest": current, "about": about}, stored.SORTED)
        scratch.drop()
        diff.unpersist()
        kinds = {r["extension"]: r["files"] for r in files_per_extension(current).collect()}
        nodes = store.read("chunks").count()
        return {"files": len(paths), "nodes": nodes, "ignored": ignored, "extensions": kinds, "changes": counts, "seconds": time.time() - began}

    def reindex(self, paths: list[str] | None = None, force: bool = False) -> dict[str, dict]:
        """Rebuild all top-level indexes, or those at or above the paths, each once."""
        if paths:
            found = {p: self.ancestor(p) for p in paths}
            if missing := [p for p, d in found.items() if d is None]:
                raise KeyError(", ".join(missing))
            directories = sorted(set(found.values()))
        else:
            directories = [r[0] for r in catalog.top_level(self.entries()).select("directory").orderBy("directory").collect()]
        return {d: self.build(d, force) for d in directories}

    # -- searching -------------------------------------------------------------------------

    def route(self, directory: str | None = None, tags: list[str] | None = None, everything: bool = False) -> list[str]:
        """Indexes that a question goes to: by tags, all, or the one at or above a directory."""
        if tags:
            found = [r[0] for r in catalog.with_tags(self.entries(), tags).select("directory").orderBy("directory").collect()]
            if not found:
                raise KeyError(f"no index has all of {tags}")
            return found
        if everything:
            return [r[0] for r in self.entries().select("directory").orderBy("directory").collect()]
        if directory is None:
            raise ValueError("name a directory or tags, or ask for all")
        children = {r["directory"]: r["children"] for r in self.entries().select("directory", "children").collect()}
        path = os.path.abspath(directory)
        while path not in children and path != os.path.dirname(path):
            path = os.path.dirname(path)
        if path not in children:
            raise KeyError(f"{directory} is not indexed")
        return [path, *(children[path] or [])]

    def query(self, question: str, k: int = 10, folder: str | None = None, directory: str | None = None, tags: list[str] | None = None, everything: bool = False) -> DataFrame:
        """rank, source, text, start_line, end_line, loc of the k best chunks of the indexes asked.

        Indexes that are not built, or of an older format (``stale``), have no part.
        """
        return self.search(question, self.route(directory, tags, everything), k, folder)

    def search(self, question: str, directories: list[str], k: int = 10, folder: str | None = None) -> DataFrame:
        """As ``query``, of the given indexes."""
        about = self._about(directories)
        built = [d for d in directories if d in about and about[d][1] == FORMAT]
        for d in built:
            if about[d][0] != self.embedder.name:
                raise ValueError(f"{d} has vectors of {about[d][0]}, not of {self.embedder.name}")
        if not built:
            raise KeyError("nothing is built yet")
        stores = [self.store(d) for d in built]

        def union(table: str) -> DataFrame:
            return reduce(DataFrame.unionByName, [s.read(table) for s in stores])

        indexes = stored.StoredIndexes(union("chunks").withColumn("root", F.col("index_id")), union("postings"), union("frequencies"), union("sizes"))
        vector = self.spark.createDataFrame([([float(x) for x in self.embedder.question(question)],)], "query array<double>")
        rows = indexes.hybrid(vector, question, k, folder).collect()  # k of them
        top = self.spark.createDataFrame(rows, "rank int, index_id string, row_id long, file string, fused double")
        return search.results(top.drop("fused"), indexes.texts(top).drop("file"))
