"""Collects the queries and SQL of the plan modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "w1_running_total"
MODULES = ["scans", "filters", "joins", "aggregates", "windows", "ordering", "functions", "sequences", "models", "streams"]
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None, tables: str = ""):
    """Registers a function of (the named tables) under its name, with its SQL."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(table(spark, sf_dir, t) for t in tables.split()))

        _QUERIES[f.__name__] = run
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"tessera.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
