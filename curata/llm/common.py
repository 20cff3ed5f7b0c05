"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_turn(values: pa.Array, rows: int = 256) -> Iterator:
    """The values as Python objects, made ``rows`` at a time: a batch of texts never lies whole in memory a second time."""
    for at in range(0, len(values), rows):
        yield from values.slice(at, rows).to_pylist()


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha256_hex(c: Column) -> Column:
    """Lower-case hex SHA-256 of a string (as UTF-8) or binary column."""
    return F.sha2(c.cast("binary"), 256)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), body)[0]
