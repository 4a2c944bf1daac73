"""Structured Streaming: event-time windows, keyed incremental state, and upserting sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import joins
from ..operators.smoothing import memory_fold
from ..sources.readers import Table


def windowed(events: DataFrame, ts: str, keys: Sequence[str], value: str, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per tumbling or sliding window; rows later than late are dropped by the watermark."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    out = rows.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, ts: str, keys: Sequence[str], value: str, gap: str, late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    out = rows.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def deduplicated(events: DataFrame, ts: str, keys: Sequence[str], late: str = "10 minutes") -> DataFrame:
    if events.isStreaming:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))
    return events.dropDuplicates(list(keys))


def joined(left: DataFrame, right: DataFrame, on, left_ts: str, right_ts: str, late: str = "10 minutes") -> DataFrame:
    """Stream-stream inner join; on must bound the distance of the two times."""
    return left.withWatermark(left_ts, late).join(right.withWatermark(right_ts, late), on)


class MemoryProcessor(StatefulProcessor):
    """Keyed memory: ema, effective number and last day per key; adjustments see earlier rows only. Rows of a batch are
    taken in order of day and tie, as in the batch operator; a day before the last one is applied without decay."""

    def __init__(self, key: str, day: str, residual: str, alpha: float, shrink: float, life: float, tie: Sequence[str] = ()):
        self.key, self.day, self.residual, self.tie = key, day, residual, list(tie)
        self.alpha, self.shrink, self.life = alpha, shrink, life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("memory", "ema double, n double, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(rows)).sort_values([self.day, *self.tie], kind="stable")
        now = self.state.get() if self.state.exists() else (0.0, 0.0, None)
        out = memory_fold(f[self.day].tolist(), f[self.residual].tolist(), self.alpha, self.shrink, self.life, (now[0], now[1], now[2]))
        last = max(int(f[self.day].max()), now[2] if now[2] is not None else -(1 << 62))
        self.state.update((float(out[1, -1]), float(out[2, -1]), last))
        yield pd.DataFrame({c: f[c] for c in (self.key, self.day, *self.tie, self.residual)} | {"adjustment": out[0], "ema": out[1], "n": out[2]})

    def close(self) -> None:
        pass


def keyed_memory(stream: DataFrame, key: str, day: str, residual: str, alpha: float, shrink: float, life: float, tie: Sequence[str] = ()) -> DataFrame:
    """day is a day number (long); tie orders the rows of a day. The session's state store must be RocksDB."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    schema = ", ".join([f"`{key}` {kinds[key]}", f"`{day}` long", *[f"`{c}` {kinds[c]}" for c in tie], f"`{residual}` double, adjustment double, ema double, n double"])
    slim = stream.select(key, F.col(day).cast("long").alias(day), *tie, F.col(residual).cast("double").alias(residual))
    return slim.groupBy(key).transformWithStateInPandas(MemoryProcessor(key, day, residual, alpha, shrink, life, tie), schema, "Append", "None")


class LedgerProcessor(StatefulProcessor):
    """Position of each (account, ticker) after every event."""

    def __init__(self, keys: Sequence[str], order: str):
        self.keys, self.order = list(keys), order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("position", "held double, cost double, price double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, cost, price = self.state.get() if self.state.exists() else (0.0, 0.0, None)
        out = []
        for r in pd.concat(list(rows)).sort_values(self.order).itertuples(index=False):
            q = 0.0 if pd.isna(r.shares) else float(r.shares)
            price = price if pd.isna(r.price) else float(r.price)
            held = round(held + q, 9)
            cost = 0.0 if held == 0 else cost + q * (price or 0.0)
            value = held * price if price is not None else None
            out.append((*key, getattr(r, self.order), held, cost / held if held else 0.0, price, value, None if value is None else value - cost))
        self.state.update((held, cost, price))
        yield pd.DataFrame(out, columns=[*self.keys, self.order, "held", "avg_cost", "market_price", "market_value", "pnl"])

    def close(self) -> None:
        pass


def ledger(stream: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in [*keys, order]], "held double, avg_cost double, market_price double, market_value double, pnl double"])
    return stream.groupBy(*keys).transformWithStateInPandas(LedgerProcessor(keys, order), schema, "Append", "None")


def upserting(table: Table, keys: Sequence[str], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the latest row of each key: a row that comes late doesn't replace one of larger
    order, and a batch that is run again gives the same table."""

    def sink(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            now = table.read()
            held = now.select(*keys, F.col(order).alias("__held"))
            fresh = batch.join(held, list(keys), "left").where(F.col("__held").isNull() | (F.col(order) >= F.col("__held"))).drop("__held")
            table.replace(joins.upsert(now, fresh, keys, F.col(order)))

    return sink


def appending_curves(path: str, make: Callable[[DataFrame], DataFrame], day: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink of daily curves; each batch has a folder of its own, so that a repeat overwrites itself and
    curves of earlier batches are untouched."""

    def sink(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            make(batch).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return sink


def updating_layers(path: str, model, memory: DataFrame, daily: DataFrame) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that takes a fitted layered model on by new days: each batch goes on from the memory and the
    daily curves of earlier batches (memory and daily hold those of the fit) and writes its own to path/memory and
    path/daily, in a folder of its own, so that a repeat overwrites itself."""

    def before(name: str, start: DataFrame, epoch: int) -> DataFrame:
        spark = start.sparkSession
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
            return start
        old = spark.read.schema(T.StructType([*start.schema, T.StructField("batch", T.LongType())])).parquet(f"{path}/{name}").where(F.col("batch") < epoch).drop("batch")
        return start.unionByName(old)

    def sink(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            new = model.update(batch, before("memory", memory, epoch), before("daily", daily, epoch))
            for name, start, df in zip(("memory", "daily"), (memory, daily), new, strict=True):
                df.select(*start.columns).write.mode("overwrite").parquet(f"{path}/{name}/batch={epoch}")

    return sink


def latest(stream: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The latest row of each key, for update mode."""
    rest = [c for c in stream.columns if c not in keys]
    best = stream.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"))
    return best.select(*keys, "r.*")
