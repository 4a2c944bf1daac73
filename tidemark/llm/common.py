"""Shared plumbing: scratch tables, Arrow batches and connected components.

Scratch tables replace lineage cuts kept on one machine: they are Parquet files in the folder named by
``spark.checkpoint.dir``, so a lost executor costs a task retry and never an intermediate result.
"""

from __future__ import annotations

import ctypes
import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only where one machine runs all and names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="tidemark-"))
    return "file://" + _OWN_DIR[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to a scratch table in the shared folder and read it back."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    _MADE.append(folder)
    df.write.parquet(f"{folder}/{name}")
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


def scratch_count() -> int:
    """Scratch tables of this driver that have not been deleted."""
    return len(_MADE)


def clear_scratch(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Deletes the scratch tables of this driver, once their results are written, but for the first since and the newest
    keep of them; how many there were."""
    gone = 0
    for folder in _MADE[since : len(_MADE) - keep]:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
        _MADE.remove(folder)
    return gone


def free_name(name: str, taken: list[str]) -> str:
    """name, with underscores in front until no column is called so."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that a worker holds few texts as Python objects at a time. What was freed goes
    back to the system after each batch and at the end, since workers live on beside the executor's heap."""
    try:
        for b in batches:
            for lo in range(0, b.num_rows, rows):
                yield b.slice(lo, rows)
            release()
    finally:
        b = None  # the last batch too
        release()


#: Bytes of one Arrow batch of a session with small_batches; a longer row is a batch by itself.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by BATCH_BYTES, unless they are smaller already. A task holds several batches
    in Python and the buffers of one in the executor; 10,000 texts, Spark's bound, are tens of MB each time. The same rows
    go through."""
    now = spark.conf.get(_BATCH_CONF, None)
    if now is None or not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) <= BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def release() -> None:
    """Gives memory that Arrow and the C library keep for later back to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux") and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def texts_of(column: pa.Array) -> list[str]:
    """A text column as Python strings; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def next_power(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


#: Edges that one task contracts at a time; up to so many need no rounds between tasks.
CONTRACTED = 1 << 20


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node reachable) of the edges u-v: roots hook on to smaller ones, then all paths are halved."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    up = np.arange(len(nodes))
    while True:
        hi, lo = np.maximum(up[a], up[b]), np.minimum(up[a], up[b])
        live = hi != lo
        if not live.any():
            return nodes, nodes[up]
        a, b = a[live], b[live]
        np.minimum.at(up, hi[live], lo[live])
        while not np.array_equal(half := up[up], up):
            up = half


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of a task as stars: every node but the smallest of its component points to that one."""

    def stars(held: list) -> pa.RecordBatch:
        node, least = smallest_reachable(*(np.concatenate(x) for x in zip(*held, strict=True)))
        at = node != least
        return pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(least[at])], names=["u", "v"])

    held, n = [], 0
    for b in batches:
        held.append((b.column("u").to_numpy(), b.column("v").to_numpy()))
        n += b.num_rows
        if n >= CONTRACTED:
            yield stars(held)
            held, n = [], 0
    if n:
        yield stars(held)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every end of an edge; component is the smallest node reachable.

    Every task first contracts its own edges to stars. If CONTRACTED or fewer edges are left, one more task contracts
    them; otherwise alternating large-star and small-star rounds follow. Each of their stars is one pre-aggregated
    minimum per node and a join back, so that a hub's edges are never gathered in one task, and each round is written to
    the shared folder. Rows with a null end and loops are ignored; no edges give an empty table.
    """
    now = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    now = materialize(now.mapInArrow(_contract, "u long, v long"), "edges")
    if now.count() <= CONTRACTED:
        now = materialize(now.coalesce(1).mapInArrow(_contract, "u long, v long"), "stars")
        return _with_roots(now)
    now = materialize(now.distinct(), "edges")
    before = None
    while True:
        now = materialize(_small_star(materialize(_large_star(now), "large")), "stars")
        seen = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(20,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before or not seen[0]:
            break
        before = seen
    return _with_roots(now)


def _with_roots(stars: DataFrame) -> DataFrame:
    out = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _large_star(e: DataFrame) -> DataFrame:
    """Each node's larger neighbours point to its smallest neighbour (or itself).

    The minima are written before they are joined, so that the join has an exchange of its own, which splits at hubs.
    """
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    out = e.select(F.col("v").alias("w"), F.col("u").alias("x")).join(least, "w")
    own = e.select(F.col("u").alias("w"), F.col("v").alias("y")).groupBy("w").agg(F.min("y").alias("m"))
    return out.select(F.col("x").alias("u"), F.col("m").alias("v")).union(own.select(F.col("w").alias("u"), F.col("m").alias("v"))).where("u > v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and itself, point to the smallest of them."""
    least = materialize(e.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")), "least")
    moved = e.select(F.col("u").alias("w"), F.col("v").alias("x")).join(least, "w").select(F.col("x").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).where("u > v").distinct()


#: Bits of a prefilter for each key, and its least and most bits: at most 32 MB are broadcast, however many keys there are.
KEY_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 28


def likely_in(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows of df whose column may be in keys (a written table of one column): all that are, and few others.

    A bitmap of the keys' hashes, made in buckets of 4 kB, is broadcast, so that rows without a partner stay where they
    are; an exact join has to follow. With far more keys than MOST_BITS it passes most rows, which costs time only.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, next_power(KEY_BITS * keys.count())))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    own = keys.select(place(F.col(keys.columns[0])).alias("p"))
    bucket, at, bits_ = (free_name(x, df.columns) for x in ("bucket", "at", "bits"))
    maps = own.groupBy(F.bitmap_bucket_number("p").alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias(bits_))
    byte = F.conv(F.hex(F.expr(f"substring({bits_}, cast({at} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    held = df.withColumns({bucket: F.bitmap_bucket_number(place(F.col(column))), at: F.bitmap_bit_position(place(F.col(column)))}).join(F.broadcast(maps), bucket)
    return held.where(byte.bitwiseAND(F.expr(f"shiftleft(1, cast({at} % 8 as int))")) != 0).select(*df.columns)


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def crc_fold(key: Column) -> Column:
    """crc32 of the key as text, modulo 5; null stays null."""
    return F.crc32(key.cast("string").cast("binary")) % 5


def tokenizer_file(name: str) -> str:
    """Default place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def worker_cache(slot: dict, key, make: Callable):
    """One object per Python worker process."""
    if key not in slot:
        slot[key] = make()
    return slot[key]


def cpu_quiet() -> None:
    """One thread per task for libraries that would start their own pools."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
