"""Results as text."""

from __future__ import annotations

from pyspark.sql import Row


def compact(rows: list[Row]) -> str:
    """One location a line."""
    return "\n".join(r["loc"] for r in rows)


def full(rows: list[Row]) -> str:
    """Numbered locations with their text; body lines have the file's own numbers, the header has none."""
    out = []
    for r in rows:
        head, _, body = r["text"].partition("\n")
        out.append(f"{r['rank']}. {r['loc']}\n    {head}")
        first = r["start_line"] or 1
        out += [f"{n:6d}  {line}" for n, line in enumerate(body.split("\n"), first)]
        out.append("")
    return "\n".join(out)
