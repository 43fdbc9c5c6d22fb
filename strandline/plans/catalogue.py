"""The registry of named queries: name -> (callable, oracle SQL or None)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules that define ``QUERIES: dict[str, tuple[callable, str | None]]``.
MODULES = [
    f"strandline.plans.{name}_queries"
    for name in ("daylog", "record", "function", "composite", "lifecycle", "window", "evaluation", "journal", "rehearsal", "ingest", "algebra", "artifact", "metric")
]

Query = Callable[[SparkSession, str], DataFrame]


def _all() -> dict[str, tuple[Query, str | None]]:
    found: dict[str, tuple[Query, str | None]] = {}
    for name in MODULES:
        found |= importlib.import_module(name).QUERIES
    return found


def queries() -> dict[str, Query]:
    """Query callables by name."""
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    """Oracle SQL by name, where there is one."""
    return {k: sql for k, (_, sql) in _all().items() if sql}
