"""Embedding near-dedup by sorted projection passes.

Equal vectors of a label form a class. In each pass every class gets a key, the concatenated signs of random projections;
classes are put in lexicographic order of (label, key) and each is compared with its next WINDOW neighbours, across
batches and across the ranges of the one exchange that all passes share, so that the pairs compared don't depend on how
rows are dealt out. Verified pairs are united across passes. Then all members of a component are compared with each
other in blocks of bounded size, which counts the links that no window held: only counts leave a block, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PASSES, BITS, WINDOW, LEAST = 20, 62, 48, 0.98
#: A component of up to WHOLE classes is one block; larger ones are cut into chunks of about 4 * sqrt(classes), at most BLOCK.
WHOLE, BLOCK = 512, 2048
SEED = 11
ORDER = ("pass", "label", "dim", "key", "cid")
ROW = "pass int, label long, dim int, key long, cid long, embedding binary"
_STRIPE = 256


def keys(x: np.ndarray, passes: int = PASSES, bits: int = BITS) -> np.ndarray:
    """(passes, rows): the signs of bits projections as one number each, first projection first."""
    planes = np.random.default_rng([SEED, x.shape[1]]).standard_normal((passes, bits, x.shape[1]))
    weight = np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64)
    return np.stack([((x @ p.T) > 0) @ weight for p in planes])


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)  # so that very large or small components neither overflow nor vanish
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def window_links(group: np.ndarray, x: np.ndarray, window: int, least: float, begin: int = 0) -> np.ndarray:
    """Pairs (i, j), i < j <= i + window, j >= begin, of unit rows with equal group and cosine >= least."""
    out = [np.empty((0, 2), dtype=np.int64)]
    for lo in range(max(0, begin - window), len(x), _STRIPE):
        i, j = np.nonzero(x[lo : lo + _STRIPE] @ x[lo : lo + _STRIPE + window].T >= least)
        near = (j > i) & (j <= i + window) & (lo + j >= begin)
        i, j = lo + i[near], lo + j[near]
        same = group[i] == group[j]
        out.append(np.stack([i[same], j[same]], axis=1))
    return np.concatenate(out)


def clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding as doubles, ok): ok is false for vectors that link with nothing."""
    e = F.transform("embedding", lambda v: v.cast("double"))
    bad = F.exists("e", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists("e", lambda v: v != 0), F.lit(False))
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), e.alias("e"))
    zero = F.transform("e", lambda v: F.when(v == 0, F.lit(0.0)).otherwise(v))
    return plain.select("vec_id", "label", F.when(ok, zero).alias("embedding"), F.coalesce(ok, F.lit(False)).alias("ok"))


def _matrix(raw: list[bytes], kind: str) -> np.ndarray:
    return _unit(np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64))


def _pairs(f: pd.DataFrame, window: int, least: float, begin: int, kind: str) -> np.ndarray:
    """Links of window_links between sorted rows f, as pairs of cid."""
    out = [np.empty((0, 2), dtype=np.int64)]
    group = pd.factorize(pd.MultiIndex.from_arrays([f["pass"], f["label"]]))[0]
    ids, raw, dims = f["cid"].to_numpy(dtype=np.int64), f["embedding"].to_numpy(), f["dim"].to_numpy()
    for dim in np.unique(dims):  # rows of one dimension are side by side within a group
        at = np.flatnonzero(dims == dim)
        out.append(ids[at[window_links(group[at], _matrix(raw[at].tolist(), kind), window, least, int((at < begin).sum()))]].reshape(-1, 2))
    return np.concatenate(out)


def _stars(pairs: np.ndarray) -> pd.DataFrame:
    """Pairs contracted to one per class that isn't the smallest of its part."""
    if not len(pairs):
        return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
    node, least = common.smallest_reachable(pairs[:, 0], pairs[:, 1])
    return pd.DataFrame({"a": node, "b": least})[node != least]


def links(classes: DataFrame, passes: int = PASSES, window: int = WINDOW, least: float = LEAST, kind: str = "<f8") -> DataFrame:
    """Pairs (a, b) of classes that connect all links found by the passes; classes: cid, label, embedding; kind: the
    numpy type that holds its numbers exactly, in which vectors travel. Cosines are in double precision whatever the kind."""

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for dim, part in f.groupby(f["embedding"].map(len)):
                for lo in range(0, len(part), 512):
                    p = part.iloc[lo : lo + 512]
                    x = np.stack(p["embedding"].tolist())
                    k, raw = keys(x, passes), [v.tobytes() for v in x.astype(kind)]
                    yield pd.concat([pd.DataFrame({"pass": i, "label": p["label"], "dim": dim, "key": k[i], "cid": p["cid"], "embedding": raw}) for i in range(passes)])

    names = [*ORDER, "embedding"]

    def edge(f: pd.DataFrame, side: str, pid: int, n: int) -> pd.DataFrame:
        return f[names].assign(a=n, b=0, pid=pid, side=side)

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Links of a range's rows, in order; its first and last rows go on to meet those of other ranges."""
        from pyspark import TaskContext

        pid, tail, n = TaskContext.get().partitionId(), None, 0
        head = []
        for f in frames:
            if not len(f):
                continue
            if n < window:
                head.append(f.head(window - n))
            n += len(f)
            both = f if tail is None else pd.concat([tail, f], ignore_index=True)
            yield _stars(_pairs(both, window, least, 0 if tail is None else len(tail), kind)).assign(**{c: None for c in names}, pid=pid, side=None)
            tail = both.tail(window)
        if n:
            yield edge(pd.concat(head), "head", pid, n)
            yield edge(tail, "tail", pid, n)

    def across(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["pid", *ORDER]).reset_index(drop=True)
        return _stars(_pairs(f, window, least, int((f["side"] == "tail").sum()), kind))

    order = classes.select("label", "cid", "embedding").mapInPandas(spread, ROW).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    done = common.materialize(order.mapInPandas(compare, f"a long, b long, pid int, side string, {ROW}"), "pairs")
    edges = done.where("side is not null")
    sizes = sorted((r[0], r[1]) for r in edges.where("side = 'tail'").groupBy("pid").agg(F.max("a")).collect())  # one row a task
    meet = classes.sparkSession.createDataFrame(_meetings(sizes, window), "pid int, side string, meet int")
    more = edges.join(meet, ["pid", "side"]).select("meet", "pid", "side", *names).groupBy("meet").applyInPandas(across, "a long, b long")
    return done.where("side is null").select("a", "b").unionByName(more)


def _meetings(sizes: list[tuple[int, int]], window: int) -> list[tuple[int, str, int]]:
    """(range, side, meeting): meeting m is that of the m-th range's first rows with the window rows before them, which
    may lie in several ranges; sizes: (range, rows) in order."""
    out = []
    for m in range(1, len(sizes)):
        out.append((sizes[m][0], "head", m))
        before, seen = m - 1, 0
        while before >= 0 and seen < window:
            out.append((sizes[before][0], "tail", m))
            seen += sizes[before][1]
            before -= 1
    return out


def link_counts(members: DataFrame, least: float = LEAST, kind: str = "<f8") -> DataFrame:
    """(cid, n): weights of the other members of its component that a class links with; members: cid, grp, weight,
    embedding. All pairs of a component meet, in blocks of one or two chunks."""
    sizes = common.materialize(members.groupBy("grp").agg(F.count("*").alias("n")), "sizes")
    most = F.when(F.col("n") <= WHOLE, F.col("n")).otherwise(F.least(F.lit(float(BLOCK)), F.greatest(F.lit(WHOLE / 2), 4 * F.sqrt("n"))))
    dealt = members.join(sizes.select("grp", F.ceil(F.col("n") / most).cast("int").alias("chunks")), "grp").withColumn("chunk", F.pmod(F.xxhash64("cid", F.lit("chunk")), "chunks").cast("int"))
    meets = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    blocks = meets.select("grp", F.least("chunk", "other").alias("ci"), F.greatest("chunk", "other").alias("cj"), "chunk", "cid", "weight", "embedding")

    def close(key, held: list) -> list[tuple[int, int]]:
        x = _matrix([r[3] for r in held], kind)
        weight, chunk = np.array([r[2] for r in held]), np.array([r[0] for r in held])
        left, right = np.flatnonzero(chunk == key[1]), np.flatnonzero(chunk == key[2])
        near = x[left] @ x[right].T >= least
        if key[1] == key[2]:
            np.fill_diagonal(near, False)
            return [(held[i][1], n) for i, n in zip(left.tolist(), (near @ weight[right]).tolist(), strict=True) if n]
        found = [*zip(left.tolist(), (near @ weight[right]).tolist(), strict=True), *zip(right.tolist(), (weight[left] @ near).tolist(), strict=True)]
        return [(held[i][1], n) for i, n in found if n]

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, out = None, [], []
        for f in frames:
            for grp, ci, cj, chunk, cid, weight, raw in f.itertuples(index=False, name=None):
                if (grp, ci, cj) != key:
                    out += close(key, held) if held else []
                    key, held = (grp, ci, cj), []
                held.append((chunk, cid, weight, raw))
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=["cid", "n"])
                out = []
        yield pd.DataFrame(out + (close(key, held) if held else []), columns=["cid", "n"])

    found = blocks.repartition("grp", "ci", "cj").sortWithinPartitions("grp", "ci", "cj", "cid").mapInPandas(rows, "cid long, n long")
    return found.groupBy("cid").agg(F.sum("n").alias("n"))


def near_duplicates(vectors: DataFrame, passes: int = PASSES, window: int = WINDOW, least: float = LEAST) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row.

    A vector that is null, empty, zero or holds null or non-finite components, or whose label is null, links with
    nothing, and so does one of another dimension than its neighbours. A null vec_id keeps its row: no links, null
    component, kept. Repeated rows are one vector; rows of equal vec_id with different vectors are one component, and
    each counts the links of its own vector. An empty table gives an empty table; other columns are ignored.
    """
    rows = common.materialize(clean(vectors).withColumn("cls", F.when(F.col("ok"), F.struct(F.xxhash64("label", "embedding"), F.hash("embedding", "label")))), "vectors")
    some = rows.where("ok")
    kind = "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    classes = some.groupBy("label", "cls").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("size"), F.first("embedding").alias("embedding"))
    classes = common.materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")  # numbers stay as written
    joined = links(classes, passes, window, least, kind)
    several = some.groupBy("vec_id").agg(F.min("label") != F.max("label"), F.min("cls") != F.max("cls")).toDF("vec_id", "p", "q").where("p or q").select("vec_id")
    several = common.materialize(several, "several")
    if not several.isEmpty():  # one vec_id may be in several classes
        own = some.join(several, "vec_id").select("vec_id", "label", "cls").join(classes.select("label", "cls", "cid"), ["label", "cls"])
        least_of = common.materialize(own.groupBy("vec_id").agg(F.min("cid").alias("b")), "several")
        joined = joined.union(own.join(least_of, "vec_id").select("cid", "b"))
    comp = common.connected_components(joined).toDF("cid", "grp")
    members = classes.join(comp, "cid").select("cid", "grp", F.col("size").alias("weight"), "rep", "label", "cls", "embedding")
    pack = lambda f: f.assign(embedding=[np.asarray(e).astype(kind).tobytes() for e in f["embedding"]])
    alike = members.select("cid", "grp", "label", "weight", "embedding").mapInPandas(lambda fs: (pack(f) for f in fs), "cid long, grp long, label long, weight long, embedding binary")
    # Only vectors of one label and dimension meet, also where a shared vec_id unites others.
    alike = alike.withColumn("grp", F.xxhash64("grp", "label", F.length("embedding")) if not several.isEmpty() else F.col("grp"))
    alike = common.materialize(alike, "members")
    more = link_counts(alike, least, kind)
    first = common.materialize(members.groupBy("grp").agg(F.min("rep").alias("component")), "components")
    known = members.select("cid", "grp").join(first, "grp").join(more, "cid", "left")
    known = classes.select("cid", "label", "cls", "rep", "size").join(known, "cid", "left")
    known = known.select("label", "cls", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("component"))
    # The written table gives the join an exchange of its own, which splits where a class holds many rows.
    known = common.materialize(known, "known")
    out = rows.select("vec_id", "label", "cls").join(known, ["label", "cls"], "left")
    whole = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), whole.alias("component_id"), F.coalesce(whole == F.col("vec_id"), F.lit(True)).alias("kept"))
