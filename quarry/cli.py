"""Command line: python -m quarry.cli COMMAND ..."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from . import render
from .operators import catalog
from .operators.embed import HashingEmbedder, OnnxEmbedder
from .operators.library import Library


def session() -> SparkSession:
    return SparkSession.builder.appName("quarry").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry")
    p.add_argument("--home", default=os.path.expanduser("~/.quarry"), help="folder of the library, shared by driver and executors")
    p.add_argument("--model", default=os.environ.get("QUARRY_MODEL"), help="folder of a sentence model, under the same path for driver and executors; without one, tokens are hashed")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *aliases: str, help: str) -> argparse.ArgumentParser:
        return sub.add_parser(name, aliases=aliases, help=help)

    c = command("index", "idx", help="build or refresh an index")
    c.add_argument("directory")
    c.add_argument("-f", "--force", action="store_true")
    c.add_argument("-s", "--split", action="store_true", default=None)
    c.add_argument("-t", "--tags", nargs="*")
    c.add_argument("-d", "--description")
    c.add_argument("-x", "--exclude", nargs="*")
    c = command("add", help="register a directory without building")
    c.add_argument("directory")
    c.add_argument("-t", "--tags", nargs="*")
    c.add_argument("-d", "--description")
    c = command("reindex", "re", help="refresh all indexes, or those of the given paths")
    c.add_argument("paths", nargs="*")
    c.add_argument("-f", "--force", action="store_true")
    c = command("query", "q", help="search")
    c.add_argument("question")
    c.add_argument("directory", nargs="?", default=".")
    c.add_argument("-k", "--top", type=int, default=10)
    c.add_argument("-f", "--folder")
    c.add_argument("-t", "--tags", nargs="*")
    c.add_argument("-a", "--all", action="store_true")
    c.add_argument("-c", "--compact", action="store_true")
    command("list", "ls", help="directories of the catalog")
    command("catalog", "cat", help="top-level indexes with their children")
    command("tags", help="tags with their directories")
    command("model", help="name of the embedding model")
    c = command("remove", "rm", help="drop an index and its children")
    c.add_argument("directory")
    c = command("tag", help="replace an index's tags")
    c.add_argument("directory")
    c.add_argument("tags", nargs="*")
    c = command("describe", help="describe an index")
    c.add_argument("directory")
    c.add_argument("description")
    c = command("split", help="split an index by subfolders, or end that")
    c.add_argument("directory")
    c.add_argument("--skip", nargs="*", default=[])
    c.add_argument("--off", action="store_true")
    c = command("server", "s", help="answer questions over HTTP")
    c.add_argument("--port", type=int, default=8765)
    c.add_argument("--idle", type=float, default=1800)
    return p


def main(argv: list[str] | None = None, library: Library | None = None) -> int:
    a = parser().parse_args(argv)
    library = library or Library(session(), a.home, OnnxEmbedder(a.model) if a.model else HashingEmbedder())
    where = os.path.abspath(a.directory) if getattr(a, "directory", None) else None
    try:
        if a.command in ("index", "idx"):
            print(library.build(where, a.force, a.split, a.tags, a.exclude))
            if a.description:
                library.describe(where, a.description)
        elif a.command == "add":
            library.add(where, a.tags, a.description)
        elif a.command in ("reindex", "re"):
            for directory, done in library.reindex(a.paths, a.force).items():
                print(directory, done)
        elif a.command in ("query", "q"):
            rows = library.query(a.question, a.top, a.folder, where, a.tags, a.all).collect()
            print(render.compact(rows) if a.compact else render.full(rows))
        elif a.command in ("list", "ls"):
            for r in library.entries().orderBy("directory").collect():
                print(r["directory"], r["indexed_at"], ",".join(r["tags"] or []))
        elif a.command in ("catalog", "cat"):
            for r in catalog.view(library.entries()).orderBy("directory", "child").collect():
                print(*[x for x in (r["directory"], r["tags"], r["description"], r["child"], r["child_tags"]) if x], sep="  ")
        elif a.command == "tags":
            for r in catalog.directories_by_tag(library.entries()).orderBy("tag", "directory").collect():
                print(r["tag"], r["directory"])
        elif a.command == "model":
            print(library.embedder.name)
        elif a.command in ("remove", "rm"):
            if not library.remove(where):
                raise KeyError(f"{where} is not indexed")
        elif a.command == "tag":
            library.tag(where, a.tags)
        elif a.command == "describe":
            library.describe(where, a.description)
        elif a.command == "split":
            print(*library.split(where, None if a.off else a.skip), sep="\n")
        else:
            from .serve import serve

            serve(library, a.port, a.idle)
    except (KeyError, ValueError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
