"""A data source of the text files below a folder.

Spark's own binary reader skips names that begin with a dot or an underscore, so this source
lists by itself: on the driver, pruning folders as it goes. Contents are read by the tasks,
which need the folder under the same path. Use it as

    spark.dataSource.register(FileSource)
    spark.read.format("source_files").option("root", "/ws/app").load()
"""

from __future__ import annotations

import json
import os
import re
import subprocess
import tempfile
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import LANGUAGES, SKIPPED_FOLDERS, glob_regex

GIT_SECONDS = 30
#: Bytes of files that one task reads, about.
TASK_BYTES = 32 << 20
SCHEMA = "path string, rel string, mtime double, size long, content binary"


def is_excluded(rel: str, patterns: list[str]) -> bool:
    """As ``quarry.functions.text.excluded``, on one path."""
    for pattern in (p.rstrip("/") for p in patterns):
        whole = [glob_regex(pattern), glob_regex(pattern + "/*")] if "/" in pattern else [glob_regex(pattern)]
        if any(re.match(regex, name) for regex in whole for name in ([rel] if "/" in pattern else rel.split("/"))):
            return True
    return False


def git_ignored(root: str, files: list[str]) -> set[str]:
    """Files that git ignores: by their own repository, or by the ignore files from the root up
    to the highest folder above it that still has one. Without git, or on any failure: none."""
    if not files:
        return set()
    names = "\0".join(files).encode()

    def ask(*place: str) -> set[str] | None:
        done = subprocess.run(["git", *place, "check-ignore", "--stdin", "-z"], input=names, capture_output=True, timeout=GIT_SECONDS, cwd=root)
        return {os.fsdecode(f) for f in done.stdout.split(b"\0") if f} if done.returncode in (0, 1) else None

    try:
        found = ask()
        if found is None:
            top = root
            while os.path.exists(os.path.join(up := os.path.dirname(top), ".gitignore")) and up != top:
                top = up
            with tempfile.TemporaryDirectory() as scratch:
                subprocess.run(["git", "init", "-q", "--bare", scratch], check=True, capture_output=True, timeout=GIT_SECONDS)
                found = ask(f"--git-dir={scratch}", f"--work-tree={top}")
        return found or set()
    except (OSError, subprocess.SubprocessError):
        return set()


def list_files(root: str, root_only: bool = False, exclude: list[str] | None = None, extensions: list[str] | None = None) -> tuple[list[str], int]:
    """Paths in order, and how many more git ignores. Linked folders are not entered."""
    root, exclude = os.path.abspath(root), exclude or []
    wanted, found = tuple(extensions or LANGUAGES), []
    for folder, below, names in os.walk(root):
        if "pyvenv.cfg" in names and not root_only:
            below.clear()
            continue
        rel = os.path.relpath(folder, root)
        inside = "" if rel == "." else rel + "/"
        below[:] = [] if root_only else sorted(d for d in below if d not in SKIPPED_FOLDERS and not is_excluded(inside + d, exclude))
        found += [os.path.join(folder, n) for n in sorted(names) if n.endswith(wanted) and not is_excluded(inside + n, exclude)]
    ignored = git_ignored(root, found)
    return [f for f in found if f not in ignored], sum(f in ignored for f in found)


def subfolders(root: str, skip: list[str] | None = None, exclude: list[str] | None = None) -> list[str]:
    """Folders just below the root that become indexes of their own, by name."""
    names = sorted(e.name for e in os.scandir(root) if e.is_dir())
    return [
        os.path.join(root, n)
        for n in names
        if not n.startswith(".") and n not in SKIPPED_FOLDERS and n not in (skip or []) and not is_excluded(n, exclude or [])
    ]


def decode(raw: bytes) -> str:
    """UTF-8 with replacement characters, and newlines of one kind."""
    return raw.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")


class _Share(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.abspath(options["root"])
        self.only = json.loads(options["paths"]) if "paths" in options else None
        self.root_only = options.get("rootonly", "false").lower() == "true"
        self.exclude = json.loads(options.get("exclude", "[]"))
        self.content = options.get("content", "true").lower() == "true"

    def partitions(self) -> list[_Share]:
        paths = self.only if self.only is not None else list_files(self.root, self.root_only, self.exclude)[0]
        shares, size = [[]], 0
        for path in paths:
            own = os.path.getsize(path) if self.content and os.path.exists(path) else 1000
            if shares[-1] and size + own > TASK_BYTES:
                shares.append([])
                size = 0
            shares[-1].append(path)
            size += own
        return [_Share(s) for s in shares]

    def read(self, partition: _Share) -> Iterator[tuple]:
        for path in partition.paths:
            rel = os.path.relpath(path, self.root) if path.startswith(self.root + os.sep) else path
            try:
                stat = os.stat(path)
                raw = None
                if self.content:
                    with open(path, "rb") as file:
                        raw = file.read()
            except OSError:
                continue
            yield path, rel, stat.st_mtime, stat.st_size, raw


class FileSource(DataSource):
    """Options: root; rootonly; exclude and paths as JSON lists; content=false for a listing."""

    @classmethod
    def name(cls) -> str:
        return "source_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
