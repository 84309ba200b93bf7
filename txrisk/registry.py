"""Query registry feeding ``__spark_entry__.queries()`` / ``oracle_sql()``.

A registered query is a callable ``(spark, sf_dir) -> DataFrame`` built from
the library's operators, plus (optionally) an independent DuckDB SQL twin.
The SQL twin is written against the fixture views ``tx`` / ``scored`` and is
prefixed with their definitions (``plans.fixture_sql``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    key: str
    fn: QueryFn
    sql: str | None


_REGISTRY: dict[str, Registered] = {}


def query(key: str, sql: str | None = None):
    """Decorator: register ``fn`` under ``key`` with an optional oracle SQL body."""

    def wrap(fn: QueryFn) -> QueryFn:
        if key in _REGISTRY:
            raise ValueError(f"duplicate query key {key!r}")
        _REGISTRY[key] = Registered(key, fn, sql)
        return fn

    return wrap


def registered() -> dict[str, Registered]:
    # importing the plans package registers every query
    from txrisk import plans  # noqa: F401

    return dict(_REGISTRY)
