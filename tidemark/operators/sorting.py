"""Sorts by explicit category orders and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def category_key(column: str, order: Sequence) -> Column:
    """Place of a value in the order; null for others."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return F.when(at > 0, at)


def sort_by_hierarchy(df: DataFrame, orders: dict[str, Sequence], columns: Sequence[str] | None = None) -> DataFrame:
    """Rows by the order of categories of each level, others last; columns in the given order, others after them."""
    df = df.orderBy(*[category_key(c, o).asc_nulls_last() for c, o in orders.items()])
    return df if columns is None else df.select(*columns, *[c for c in df.columns if c not in columns])


def top_k(df: DataFrame, keys: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*keys).limit(k)
