"""Registered queries: each applies operators to a derivation of the supplied tables, with an independent SQL oracle."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("intervals", "islands", "aggregates", "scalars", "motion", "sequential", "files", "streams", "workers", "retimer", "media", "plugins")
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with its DuckDB oracle."""

    def register(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return register


def load() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return dict(_queries), dict(_sql)
