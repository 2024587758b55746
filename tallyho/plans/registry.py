"""Registry of named queries and their DuckDB oracle SQL.

A query is ``fn(spark, sf_dir) -> DataFrame`` over the whole test tables.
Its oracle is ANSI SQL that DuckDB runs over the same parquet tables; the
bindings of ``tallyho.sources.bindings`` appear there as CTEs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DOCS: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    """Decorator: register ``fn`` under ``key`` with optional oracle SQL."""
    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        DOCS[key] = (fn.__doc__ or "").strip()
        if sql is not None:
            ORACLES[key] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from tallyho.plans import (  # noqa: F401
        q_compare, q_text, q_replies, q_batching, q_reconcile, q_quality,
        q_monitor, q_models, q_streaming, q_search)
