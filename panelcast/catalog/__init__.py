"""Registered queries on the driver tables, each next to its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.scalars import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None):
    """Add a ``(spark, sf_dir) -> DataFrame`` query, with SQL when SQL can express it."""
    def add(function):
        key = name or function.__name__
        QUERIES[key] = function
        if sql is not None:
            ORACLES[key] = sql
        return function
    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Settle the named columns (default: every double)."""
    columns = columns or tuple(c for c, t in df.dtypes if t == "double")
    return df.withColumns({c: settle(c, digits) for c in columns})


def everything() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Import every query module and return the registry."""
    from . import extra_queries, forecast_queries, indicator_queries, panel_queries, spatial_queries  # noqa: F401
    return QUERIES
