"""Scans and sinks: Parquet, ORC, CSV, JSON, JDBC, and swaps of whole tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, path: str, form: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """A scan; text formats want a schema, so that nothing is read twice to infer one."""
    if form in ("csv", "json") and schema is None and not options.get("inferSchema"):
        raise ValueError(f"{form} needs a schema")
    r = spark.read.format(form).options(**({"header": "true"} if form == "csv" else {})).options(**options)
    return (r.schema(schema) if schema else r).load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options) -> DataFrame:
    """A database table; column, low and high cut the scan into parts ranges."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if column:
        r = r.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return r.load()


def write(df: DataFrame, path: str, form: str = "parquet", mode: str = "overwrite", partition_by: tuple[str, ...] = (), **options) -> None:
    w = df.write.format(form).mode(mode).options(**options)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def stage_jdbc(df: DataFrame, url: str, table: str, **options) -> str:
    """Rows to a fresh staging table, whose name is returned for the database's own merge."""
    name = f"{table}_{uuid.uuid4().hex[:8]}"
    df.write.format("jdbc").option("url", url).option("dbtable", name).options(**options).mode("error").save()
    return name


_OWN: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A fresh folder that all executors share, under the one that spark.checkpoint.dir names; a local one only where one
    machine runs all and none is named."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="tidemark-tables-"))
        found = "file://" + _OWN[0]
    return f"{found.rstrip('/')}/tables-{uuid.uuid4().hex}"


class Table:
    """A Parquet table that is replaced by writing a new folder and moving a pointer, so that readers see old or new rows."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self):
        jvm, path = self.spark._jvm, self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _current(self) -> str | None:
        fs, path = self._fs()
        at = path(self.path)
        if not fs.exists(at):
            return None
        names = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().startswith("v"))
        done = [n for n in names if fs.exists(path(f"{self.path}/{n}/_SUCCESS"))]
        return done[-1] if done else None

    def read(self) -> DataFrame:
        now = self._current()
        if now is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{now}")

    def replace(self, df: DataFrame) -> int:
        """Writes the next version; the one before stays for readers that have begun, older ones go."""
        now = self._current()
        after = f"v{int(now[1:]) + 1 if now else 1:09d}"
        df.write.mode("overwrite").parquet(f"{self.path}/{after}")
        fs, path = self._fs()
        for s in fs.listStatus(path(self.path)):
            name = s.getPath().getName()
            if name.startswith("v") and now and name < now:
                fs.delete(s.getPath(), True)
        return self.count()

    def count(self) -> int:
        return self.read().count()

    def clear(self) -> None:
        self.replace(self.spark.createDataFrame([], self.schema))

    def drop(self) -> None:
        fs, path = self._fs()
        fs.delete(path(self.path), True)
