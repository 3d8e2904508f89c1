"""Registry behind ``__spark_entry__.queries()`` / ``oracle_sql()``.

A registered query is ``fn(tables: TableSet) -> DataFrame`` plus an optional
DuckDB SQL oracle written against the same fixture views (prepended as CTEs).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import FIXTURES, TableSet, duckdb_ctes

# Fixed clock and parameters shared by every registered query and its oracle.
AS_OF = "2001-08-02 00:00:00"
GRACE_HOURS = 12
RUN_ID = "run-20010802"
TZ = "UTC"

_REGISTRY: dict[str, tuple[Callable[[TableSet], DataFrame], str | None]] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Callable[[TableSet], DataFrame]):
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")
        _REGISTRY[name] = (fn, oracle)
        return fn
    return deco


def _fixtures_in(sql: str) -> list[str]:
    return [n for n in FIXTURES if re.search(rf"\b{n}\b", sql)]


def with_fixtures(sql: str) -> str:
    """Prefix the fixture CTEs an oracle statement refers to."""
    body = sql.strip()
    names = _fixtures_in(body)
    if not names:
        return body
    head = duckdb_ctes(names)
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + head[5:].rstrip() + ",\n" + body[15:]
    if body[:5].upper() == "WITH ":
        return head.rstrip() + ",\n" + body[5:]
    return head + body


def _load_all() -> None:
    from . import (ingest_views, master_views, reconcile_views, report_views,  # noqa: F401
                   storage_views, stream_views, workflow_views)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()

    def bind(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(TableSet(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        return run

    return {name: bind(fn) for name, (fn, _) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {name: with_fixtures(sql) for name, (_, sql) in _REGISTRY.items() if sql}


def run(name: str, tables: TableSet) -> DataFrame:
    """Build one registered query over an existing :class:`TableSet`."""
    _load_all()
    return _REGISTRY[name][0](tables)


def names() -> list[str]:
    _load_all()
    return list(_REGISTRY)
