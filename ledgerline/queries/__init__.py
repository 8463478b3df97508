"""Named queries of the library, each over whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, logs, meter, sources, watch, writes

PARTS = [audit, meter, logs, writes, watch, sources]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: q for part in PARTS for name, q in part.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
