"""A named registry of datasets, result caches and deterministic generators."""

from __future__ import annotations

import hashlib
import threading
import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PREFIX = "pin_"


class Pins:
    """Datasets by name, as cached temporary views."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def put(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(_PREFIX + name)
        self.spark.catalog.cacheTable(_PREFIX + name)

    def put_parquet(self, name: str, path: str) -> None:
        self.put(name, self.spark.read.parquet(path))

    def get(self, name: str) -> DataFrame:
        if not self.exists(name):
            raise KeyError(name)
        return self.spark.table(_PREFIX + name)

    def exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(_PREFIX + name)

    def drop(self, name: str) -> None:
        if self.exists(name):
            self.spark.catalog.uncacheTable(_PREFIX + name)
            self.spark.catalog.dropTempView(_PREFIX + name)

    def list(self) -> list[str]:
        return sorted(t.name.removeprefix(_PREFIX) for t in self.spark.catalog.listTables() if t.isTemporary and t.name.startswith(_PREFIX))

    def drop_all(self) -> None:
        for name in self.list():
            self.drop(name)

    def info(self, name: str) -> dict:
        df = self.get(name)
        return {"rows": df.count(), "columns": dict(df.dtypes)}


class ResultCache:
    """Frames kept as Parquet under the hash of a name, arguments and input plans; expiry in seconds."""

    def __init__(self, spark: SparkSession, path: str, expiry: float | None = None):
        self.spark, self.path, self.expiry = spark, path.rstrip("/"), expiry

    def key(self, name: str, *args) -> str:
        parts = [str(a.semanticHash()) if isinstance(a, DataFrame) else repr(a) for a in args]
        return hashlib.sha256("\x1f".join([name, *parts]).encode()).hexdigest()[:32]

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def get(self, name: str, make: Callable[..., DataFrame], *args, force: bool = False) -> DataFrame:
        path = f"{self.path}/{self.key(name, *args)}"
        fs, p = self._fs(f"{path}/_SUCCESS")
        fresh = fs.exists(p) and (self.expiry is None or time.time() - fs.getFileStatus(p).getModificationTime() / 1000 < self.expiry)
        if force or not fresh:
            make(*args).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def clean(self, older: float, dry_run: bool = True) -> list[str]:
        """Entries older than so many seconds; they go only if dry_run is false."""
        fs, p = self._fs(self.path)
        old = [s.getPath() for s in fs.listStatus(p) if time.time() - s.getModificationTime() / 1000 > older] if fs.exists(p) else []
        if not dry_run:
            for x in old:
                fs.delete(x, True)
        return [x.getName() for x in old]


class FrameCache:
    """The most recently used frames, persisted; those that fall out are released."""

    def __init__(self, size: int = 8):
        self.size, self.held, self.lock = size, OrderedDict(), threading.Lock()

    def get(self, key, make: Callable[[], DataFrame]) -> DataFrame:
        with self.lock:
            if key in self.held:
                self.held.move_to_end(key)
                return self.held[key]
            self.held[key] = df = make().persist()
            if len(self.held) > self.size:
                self.held.popitem(last=False)[1].unpersist()
            return df


def _uniform(*parts) -> Column:
    """A number in 0..1 that depends on the row's keys alone, so that retries give the same rows."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / float(1 << 40)


def _normal(*parts):
    return F.sqrt(-2 * F.log(F.greatest(_uniform(*parts, F.lit("u")), F.lit(1e-12)))) * F.cos(F.lit(6.283185307179586) * _uniform(*parts, F.lit("v")))


def loan_prices(spark: SparkSession, days: int, per_day: int = 100, overlap: float = 0.9, start: str = "2023-01-02", seed: int = 0) -> DataFrame:
    """(date, loan_id, price, balance): each day's loans are mostly those of the day before."""
    move = max(1, round(per_day * (1 - overlap)))
    rows = spark.range(days).select(F.col("id").alias("d")).select("d", F.explode(F.sequence(F.lit(0), F.lit(per_day - 1))).alias("i"))
    loan = F.col("d") * move + F.col("i")
    s = F.lit(seed)
    price = 95 + 8 * _uniform(loan, s, F.lit("p")) + 0.3 * _normal(loan, F.col("d"), s)
    return rows.select(F.date_add(F.lit(start).cast("date"), F.col("d").cast("int")).alias("date"), F.format_string("L%06d", loan).alias("loan_id"), F.round(price, 4).alias("price"), (F.floor(_uniform(loan, s, F.lit("b")) * 900_000) + 100_000).cast("long").alias("balance"))


def bond_trades(spark: SparkSession, days: int, per_rating: int = 5, seed: int = 0) -> DataFrame:
    """(date, ticker, rating, feature_a..d, expiry, yield)."""
    ratings = F.array(*map(F.lit, ("AAA", "AA", "A", "BBB")))
    rows = spark.range(days).select(F.date_add(F.lit("2023-01-02").cast("date"), F.col("id").cast("int")).alias("date"), F.explode(ratings).alias("rating"))
    rows = rows.select("date", "rating", F.explode(F.sequence(F.lit(1), F.lit(per_rating))).alias("i"))
    s = F.lit(seed)
    feats = {f"feature_{c}": _normal(F.col("date"), F.col("rating"), F.col("i"), s, F.lit(c)) for c in "abcd"}
    level = F.array_position(ratings, F.col("rating")).cast("double")
    rows = rows.withColumn("ticker", F.concat("rating", F.lit("_"), F.col("i").cast("string"))).withColumns(feats)
    return rows.withColumn("expiry", F.date_add("date", (365 + 3650 * _uniform(F.col("ticker"), s)).cast("int"))).withColumn("yield", 2 + level * 0.5 + 0.1 * F.col("feature_a") + 0.05 * _normal(F.col("date"), F.col("ticker"), s)).drop("i")


def happiness(spark: SparkSession, rows: int, seed: int = 0) -> DataFrame:
    """(age, income, education, level, happiness) with smooth effects."""
    i, s = F.col("id"), F.lit(seed)
    df = spark.range(rows).select("id", (18 + 62 * _uniform(i, s, F.lit("a"))).alias("age"), (20 + 100 * _uniform(i, s, F.lit("i"))).alias("income"), F.floor(8 + 12 * _uniform(i, s, F.lit("e"))).cast("double").alias("education"), F.element_at(F.array(*map(F.lit, ("low", "mid", "high"))), (F.floor(3 * _uniform(i, s, F.lit("l"))) + 1).cast("int")).alias("level"))
    level = F.when(F.col("level") == "high", 1.0).when(F.col("level") == "low", -1.0).otherwise(0.0)
    return df.withColumn("happiness", 5 + F.sin(F.col("age") / 12) + F.log("income") / 2 + 0.05 * F.col("education") + level + 0.2 * _normal(i, s, F.lit("h"))).drop("id")
