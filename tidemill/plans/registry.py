"""Registry of named queries: a builder and, where SQL can say it, its oracle."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
#: Modules that register queries when they are imported.
_MODULES = ("stream_queries", "table_queries", "expression_queries", "lakehouse_queries", "markup_queries", "io_queries", "streaming_queries", "state_queries", "scan_queries")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a builder ``(spark, sf_dir) -> DataFrame`` under ``name``."""

    def put(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark alone (any path it can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"tidemill.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _ORACLES
