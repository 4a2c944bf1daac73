"""Unions and key-set operations."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL of frames with the same set of columns, in any order; other columns are an error."""
    if not frames:
        raise ValueError("nothing to stack")
    names = set(frames[0].columns)
    for f in frames[1:]:
        if set(f.columns) != names:
            raise ValueError(f"columns differ: {sorted(names ^ set(f.columns))}")
    return functools.reduce(lambda a, b: a.unionByName(b), frames)


def concat(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL with columns aligned by name and absent ones null."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def common_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def missing_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of a that b lacks."""
    return a.select(*keys).subtract(b.select(*keys))


def intersect_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersectAll(b.select(*a.columns))


def except_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b.select(*a.columns))
