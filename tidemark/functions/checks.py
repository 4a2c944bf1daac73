"""Checks of values, order and schema."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def only_values(df: DataFrame, column: str, allowed: Iterable) -> DataFrame:
    """One row: whether every present value is allowed."""
    return df.agg(F.coalesce(F.bool_and(F.col(column).isin(list(allowed))), F.lit(True)).alias("ok"))


def is_sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str) -> DataFrame:
    """One row: whether the column never falls along the order within a key."""
    before = F.lag(column).over(Window.partitionBy(*keys).orderBy(*order))
    return df.select((before <= F.col(column)).alias("up")).agg(F.coalesce(F.bool_and("up"), F.lit(True)).alias("ok"))


def same_range(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: whether both frames span the same first and last value."""
    ends = lambda d, n: d.agg(F.min(column).alias(f"lo{n}"), F.max(column).alias(f"hi{n}"))
    return ends(a, 1).join(F.broadcast(ends(b, 2))).select((F.col("lo1").eqNullSafe(F.col("lo2")) & F.col("hi1").eqNullSafe(F.col("hi2"))).alias("ok"))


def missing_columns(df: DataFrame, wanted: Iterable[str]) -> list[str]:
    return [c for c in wanted if c not in df.columns]


def require(df: DataFrame, wanted: Iterable[str]) -> None:
    if gone := missing_columns(df, wanted):
        raise KeyError(f"missing columns: {gone}")


def is_date(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.simpleString() in ("date", "timestamp", "timestamp_ntz")


def is_range(df: DataFrame, column: str) -> DataFrame:
    """One row: whether the column holds 0 .. n - 1, each once."""
    a = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count_distinct(column).alias("d"), F.count("*").alias("n"))
    return a.select(((F.col("n") == 0) | ((F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("d") == F.col("n")))).alias("ok"))
