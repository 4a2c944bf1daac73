"""The identifier store: mappings of three kinds of security ids, and ids known to be invalid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins
from .readers import Table

KINDS = ("cusip", "isin", "ticker")


class IdentifierStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.maps = Table(spark, f"{path}/mappings", "cusip string, isin string, ticker string, last_updated timestamp")
        self.bad = Table(spark, f"{path}/invalid", "identifier string, first_seen timestamp")

    def mappings(self) -> DataFrame:
        return self.maps.read()

    def invalid(self) -> DataFrame:
        return self.bad.read()

    def add(self, df: DataFrame) -> int:
        """Adds or overwrites by cusip; names are lower-cased, rows without cusip are dropped, other ids may be absent."""
        df = df.toDF(*[c.lower() for c in df.columns])
        if "cusip" not in df.columns:
            raise ValueError("cusip column is needed")
        rows = df.select("cusip", *[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in KINDS[1:]]).where("cusip is not null")
        one = rows.groupBy("cusip").agg(F.max_by(F.struct("isin", "ticker"), F.struct("isin", "ticker")).alias("r"))
        new = one.select("cusip", "r.isin", "r.ticker", F.current_timestamp().alias("last_updated"))
        return self.maps.replace(joins.upsert(self.mappings(), new, ["cusip"]))

    def add_invalid(self, ids: Sequence[str]) -> int:
        new = self.spark.createDataFrame([(i,) for i in ids], "identifier string").withColumn("first_seen", F.current_timestamp())
        return self.bad.replace(joins.insert_ignore(self.invalid(), new, ["identifier"]))

    def frame(self, ids: Sequence[str]) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(ids)), "pos long, id string")

    def convert(self, ids: DataFrame, source: str, target: str) -> DataFrame:
        """One of the six directions; input order and repeats are kept."""
        return joins.lookup(ids, self.mappings(), source, target)

    def mixed_to_cusip(self, ids: DataFrame) -> DataFrame:
        return joins.resolve_mixed(ids, self.mappings(), KINDS, "cusip", self.invalid().select(F.col("identifier").alias("id")))

    def exist(self, ids: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
        return joins.exist_flags(ids, self.mappings(), kinds)

    def is_invalid(self, ids: DataFrame) -> DataFrame:
        return joins.exist_flags(ids, self.invalid(), ["identifier"])
