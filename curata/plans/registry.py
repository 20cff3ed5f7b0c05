"""Registry of named queries: a Spark builder and, where SQL can say it, a DuckDB oracle.

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
test tables (or data Spark derives from them).  Oracle strings run in DuckDB on
the same parquet files; both sides alias every computed column to the same
name and round doubles to 6 digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from curata.plans.oracle_views import with_views

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Decorator: register `fn` under `name`, with an optional oracle SQL body."""

    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(views, sql)
        return fn

    return deco


def load_all() -> None:
    """Import every query module so that the registry is filled."""
    from curata.plans import (  # noqa: F401
        corpus_queries,
        experiment_queries,
        head_queries,
        metric_queries,
        source_queries,
        split_queries,
        text_queries,
    )
