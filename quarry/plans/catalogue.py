"""The retrieval engine's queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import retrieval, upkeep

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**retrieval.QUERIES, **upkeep.QUERIES}
ORACLES: dict[str, str] = {**retrieval.ORACLES, **upkeep.ORACLES}
