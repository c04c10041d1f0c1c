"""Registered queries: each is a Spark job over the driver's tables (or views
Spark derives from them) paired, where SQL can say it, with a DuckDB oracle.

Registered outputs are flat: arrays are joined with '|', money is shown as a
double with two decimals, so both engines print identical rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.plans.oracle_views import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            if views:
                ORACLES[name] = with_views(sql, *views)
            elif sql.lstrip().startswith(","):
                ORACLES[name] = "WITH " + sql.lstrip()[1:]
            else:
                ORACLES[name] = sql
        return fn
    return deco


def joined(c: str | Column, sep: str = "|") -> Column:
    return F.array_join(F.col(c) if isinstance(c, str) else c, sep)


def money(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def load_all() -> None:
    """Import the modules that register queries (idempotent)."""
    from vitrine.plans import queries_catalog, queries_dml, queries_documents, queries_events, queries_outbox, queries_monitor, queries_search, queries_sources, queries_streaming  # noqa: F401
