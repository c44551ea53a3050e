"""Registry of checked queries."""

from __future__ import annotations

import functools
import importlib
import textwrap
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakesync.session import set_runtime_defaults

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}

MODULES = (
    "sources", "extraction", "shaping", "schemas", "syncing", "relational", "scoring", "quality",
    "writing", "changes", "ledgers", "streams", "hooks", "flagship",
)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and the SQL that must give the same rows."""
    def add(function: Query) -> Query:
        if name in _queries:
            raise ValueError(f"query {name!r} registered twice")

        @functools.wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            set_runtime_defaults(spark)
            return function(spark, sf_dir)

        _queries[name] = run
        if sql is not None:
            _oracles[name] = textwrap.dedent(sql).strip()
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"lakesync.queries.{module}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(_oracles)
