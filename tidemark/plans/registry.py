"""Queries with their SQL, collected by decorator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


class Tables:
    """Tables of a folder, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Registers make(tables) -> DataFrame under its name, with SQL for the same rows."""

    def add(make: Callable[[Tables], DataFrame]) -> Callable:
        key = name or make.__name__
        QUERIES[key] = lambda spark, folder: make(Tables(spark, folder))
        if sql:
            SQL[key] = sql
        return make

    return add


def rounded(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded_scaled(c: Column | str, digits: int = 6) -> Column:
    """A double rounded as the SQL does it: times a power of ten, halves away from zero, divided again. ``rounded`` takes
    the shortest decimal text instead, which can be a half where the product is not."""
    c = F.col(c) if isinstance(c, str) else c
    scaled = c * F.lit(10.0**digits)
    return F.when(F.abs(scaled) == float("inf"), c).otherwise(F.round(scaled) / F.lit(10.0**digits))


def round_all(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits, so that the order of summation doesn't show."""
    return df.select(*[F.round(f"`{f.name}`", digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f"`{f.name}`") for f in df.schema])
