"""Registry of named queries and their DuckDB oracle statements.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame over the driver's
tables (whole tables, no sampling).  ``ORACLE[name]`` is the same result as
DuckDB SQL; queries without one get a rows-only check.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from . import q_kpis, q_views, q_clean, q_csv, q_dates, q_refresh, q_profile, q_brief, q_questions, q_text  # noqa: F401
