"""Registry of queries: each is a function (spark, sf_dir) -> DataFrame beside the SQL that an oracle can run."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "flagship_curate_profile"
#: Modules whose import registers queries.
AREAS = ("relational_queries", "text_queries", "model_queries")

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query under name, with its SQL if SQL can express it."""
    def keep(f):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f
    return keep


def _load() -> None:
    for area in AREAS:
        importlib.import_module(f"millrace.plans.{area}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def sql_of(name: str) -> str:
    """SQL of a query registered above, to be part of another's."""
    return _SQL[name]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
