"""MinHash near-duplicate detection with sequential Bayesian verification.

1. Texts with equal shingle sets form a class; its smallest doc_id stands for it.
2. Representatives get BANDS * ROWS min-hashes. Per band, every representative is tied to the smallest one with the same
   band (a pre-aggregated minimum and a join: as many ties as rows, however full a bucket is). Connected ties are groups.
3. Groups are dealt out in blocks of one or two chunks, cut by members and by bytes. In a block, a member meets all
   others that share a band with it and that it isn't connected to yet: batches of signatures are compared, a pair is
   pruned once the posterior probability of similarity >= 0.75 falls under MISS, and survivors are verified on their full
   shingle sets, one member against all its survivors at a time.
4. A group larger than one block first meets its own first chunk; members that this does not join to the group's
   largest part are then compared with all members, again in blocks. No bucket or group is capped, and no pair that
   could change a component goes unseen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .texthash import SMALL, blocks, mix, shingles_of_block

BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
BATCH, MISS = 40, 1e-6
NUM, DEN = 75, 100
#: A group of up to WHOLE members is one block; larger ones are cut into chunks of about 4 * sqrt(members), at most BLOCK.
WHOLE, BLOCK = 256, 1024
#: Shingle hashes of a chunk, about; a group with more is cut into more chunks (a longer text is a chunk by itself).
CHUNK_SHINGLES = 1 << 21
_RNG = np.random.default_rng(20240229)
_MUL = (_RNG.integers(1, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
SETS = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"
KEY = ("n_shingles", "set_a", "set_b")
MEMBERS = "grp long, ci int, cj int, doc_id long, chunk int, signature binary, shingles binary"


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least of each of HASHES hash functions over the set."""
    out = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for lo in range(0, len(x), 2048):
        np.minimum(out, (x[lo : lo + 2048, None] * _MUL + _ADD).min(axis=0), out=out)
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of a signature, or of each row of signatures."""
    rows = sig.reshape(*sig.shape[:-1], BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        key = mix(key + rows[..., k])
    return key.view(np.int64)


@lru_cache
def least_matches() -> tuple[int, ...]:
    """After each batch, the fewest equal hashes with P(similarity >= 0.75 | matches) >= MISS under a uniform prior."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        # The posterior is Beta(m + 1, n - m + 1); P(s >= t) is the chance of at most m successes in n + 1 trials at t.
        t, below = NUM / DEN, 0.0
        for m in range(n + 1):
            below += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(t) + (n + 1 - m) * math.log(1 - t))
            if below >= MISS:
                out.append(m)
                break
    return tuple(out)


def survivors(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Indexes of rows of many that share a band with one and are not pruned by any batch."""
    return pruned(one, many, np.flatnonzero((bands(many) == bands(one)).any(axis=-1)))


def pruned(one: np.ndarray, many: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Those of left, indexes of rows of many, whose batches of signatures leave similarity >= 0.75 to one possible."""
    matches = np.zeros(len(left), dtype=np.int64)
    for k, least in enumerate(least_matches()):
        if not len(left):
            break
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (many[left, part] == one[part]).sum(axis=1)
        left, matches = left[matches >= least], matches[matches >= least]
    return left


class Sets:
    """The shingle sets of a block, with shingles renumbered, so that one set is held against many at once."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(x) for x in sets], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        names, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.seen = np.zeros(len(names), dtype=bool)

    def similar(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of others with 100 * intersection >= 75 * union with set i."""
        small, large = np.minimum(self.size[i], self.size[others]), np.maximum(self.size[i], self.size[others])
        others = others[(DEN * small >= NUM * large) & (small > 0)]
        if not len(others):
            return others
        own = self.flat[self.start[i] : self.start[i + 1]]
        self.seen[own] = True
        hits = self.seen[np.concatenate([self.flat[self.start[j] : self.start[j + 1]] for j in others.tolist()])]
        self.seen[own] = False
        size = self.size[others]
        both = np.add.reduceat(hits, np.cumsum(size) - size, dtype=np.int64)
        return others[DEN * both >= NUM * (self.size[i] + size - both)]


def links_of_block(ids: list[int], sigs: np.ndarray, sets: list[np.ndarray], left: np.ndarray | None) -> list[tuple[int, int]]:
    """Links that join a block's members; left: the members of one of two chunks to compare with the other, or None to
    compare all pairs."""
    n, out = len(ids), []
    part, keys, held = np.arange(n), bands(sigs), Sets(sets)
    right = None if left is None else np.flatnonzero(~left)
    for i in range(n - 1) if left is None else np.flatnonzero(left).tolist():
        others = np.arange(i + 1, n) if right is None else right
        others = others[part[others] != part[i]]
        others = others[(keys[others] == keys[i]).any(axis=1)]
        found = held.similar(i, pruned(sigs[i], sigs, others))
        if len(found):
            parts, first = np.unique(part[found], return_index=True)
            out += [(ids[i], ids[j]) for j in found[first].tolist()]
            joined = np.append(parts, part[i])
            part[np.isin(part, joined)] = joined.min()
    return out


def sets_of(docs: DataFrame) -> DataFrame:
    """Size, digest and bands of each row's shingle set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.in_slices(batches):
            raw = [t.encode() for t in common.texts_of(b.column("text"))]
            n, a, c, keys = [], [], [], []
            for _, run in blocks(raw, SMALL):
                for s in shingles_of_block(run):
                    n.append(len(s))
                    a.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                    c.append(int(np.bitwise_xor.reduce(mix(s), initial=0).astype(np.uint64).view(np.int64)))
                    keys.append(bands(signature(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=[x.split()[0] for x in SETS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, SETS)


def _members(texts: DataFrame) -> DataFrame:
    """Signature and shingles of each representative; texts: grp, doc_id, text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.in_slices(batches):
            sigs, sets, n = [], [], []
            for _, run in blocks([t.encode() for t in common.texts_of(b.column("text"))], SMALL):
                for s in shingles_of_block(run):
                    sigs.append(signature(s).tobytes())
                    sets.append(s.tobytes())
                    n.append(len(s))
            yield pa.RecordBatch.from_arrays([b.column("grp"), b.column("doc_id"), pa.array(n, pa.int64()), pa.array(sigs, pa.binary()), pa.array(sets, pa.binary())], names=["grp", "doc_id", "size", "signature", "shingles"])

    return texts.select("grp", "doc_id", "text").mapInArrow(rows, "grp long, doc_id long, size long, signature binary, shingles binary")


def _compare(dealt: DataFrame) -> DataFrame:
    """(grp, a, b): links of blocks (grp, ci, cj): chunk ci against itself (ci = cj) or against chunk cj."""

    def close(key, held: list) -> list[tuple[int, int, int]]:
        if len(held) < 2:
            return []
        ids = [x[0] for x in held]
        sigs = np.stack([np.frombuffer(x[2], dtype=np.uint32) for x in held])
        left = None if key[1] == key[2] else np.array([x[1] == key[1] for x in held])
        return [(key[0], *x) for x in links_of_block(ids, sigs, [np.frombuffer(x[3], dtype=np.uint64) for x in held], left)]

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, out = None, [], []
        for f in frames:
            for grp, ci, cj, doc, chunk, sig, sh in f.itertuples(index=False, name=None):
                if (grp, ci, cj) != key:
                    out += close(key, held)
                    key, held = (grp, ci, cj), []
                held.append((doc, chunk, sig, sh))
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=["grp", "a", "b"])
                out = []
        yield pd.DataFrame(out + close(key, held), columns=["grp", "a", "b"])

    order = dealt.select(*[x.split()[0] for x in MEMBERS.split(", ")]).repartition("grp", "ci", "cj").sortWithinPartitions("grp", "ci", "cj", "doc_id")
    return order.mapInPandas(rows, "grp long, a long, b long")


def _chunks(n: Column, shingles: Column, all_members: Column | None = None) -> Column:
    """Into how many chunks n members with so many shingles are cut; all_members: those of their whole group."""
    whole = n if all_members is None else all_members
    size = F.when(whole <= WHOLE, whole).otherwise(F.least(F.lit(float(BLOCK)), F.greatest(F.lit(WHOLE / 2), 4 * F.sqrt(whole))))
    return F.ceil(F.greatest(n / size, shingles / F.lit(CHUNK_SHINGLES))).cast("int")


def _chunk(doc: Column, count: Column) -> Column:
    return F.pmod(F.xxhash64(doc, F.lit("chunk")), count).cast("int")


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row.

    Null or empty text, or text of blanks: no shingles, linked with nothing. Rows of equal doc_id count as one document
    whose links are those of all its texts. Rows with a null doc_id link with nothing; their component is null and they
    are kept. An empty table gives an empty table. Other columns are ignored.
    """
    sets = common.materialize(sets_of(docs), "sets")
    some = sets.where("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy(*KEY).agg(F.min(F.struct("doc_id", "bands")).alias("r"))
    classes = common.materialize(classes.select(*KEY, F.col("r.doc_id").alias("rep"), F.col("r.bands").alias("bands")), "classes")
    spread = classes.select("rep", F.explode("bands").alias("band"))
    hubs = spread.groupBy("band").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    hubs = common.materialize(hubs, "hubs")
    ties = spread.join(hubs, "band").where("rep <> hub")
    groups = common.materialize(common.connected_components(ties, "rep", "hub").toDF("doc_id", "grp"), "groups")
    # Only texts of group members, and a few more, move.
    texts = common.likely_in(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", groups.select("doc_id")).join(groups, "doc_id")
    members = common.materialize(_members(texts), "members")
    sizes = members.groupBy("grp").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    sizes = common.materialize(sizes.select("grp", "n", _chunks(F.col("n"), F.col("shingles")).alias("chunks")), "sizes")
    dealt = members.join(sizes, "grp").withColumn("chunk", _chunk(F.col("doc_id"), F.col("chunks")))
    meets = F.when(F.col("chunk") == 0, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("chunk"))
    links = common.materialize(_compare(dealt.select("*", F.explode(meets).alias("cj")).withColumn("ci", F.lit(0))), "links")
    large = sizes.where("chunks > 1")
    if not large.isEmpty():  # without large groups every pair has met
        links = links.unionByName(_rest(dealt, links, large))
    joined = links.select("a", "b")
    several = common.materialize(sets.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "several")
    repeated = not several.isEmpty()
    if repeated:  # one document may be in several classes
        joined = joined.union(some.join(several, "doc_id").join(classes.select(*KEY, "rep"), list(KEY)).select("doc_id", "rep"))
    found = common.connected_components(joined)
    known = classes.select(*KEY, "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select(*KEY, F.coalesce("component", "rep").alias("component"))
    # The written table gives the join an exchange of its own, which splits where a class holds many rows.
    known = common.materialize(known, "known")
    out = sets.select("doc_id", *KEY).join(known, list(KEY), "left")
    whole = F.coalesce("component", "doc_id")
    if repeated:
        out = out.join(found.toDF("doc_id", "linked"), "doc_id", "left")
        whole = F.coalesce("linked", whole)
    whole = F.when(F.col("doc_id").isNotNull(), whole)
    return out.select("doc_id", "n_shingles", whole.alias("component_id"), F.coalesce(whole == F.col("doc_id"), F.lit(True)).alias("kept"))


def _rest(members: DataFrame, links: DataFrame, large: DataFrame) -> DataFrame:
    """Links of large groups between members outside the group's largest part so far and all members."""
    big = members.join(large.select("grp"), "grp", "left_semi")
    parts = common.connected_components(links.join(large.select("grp"), "grp", "left_semi")).toDF("doc_id", "part")
    known = big.select("grp", "doc_id", "n", "size").join(parts, "doc_id", "left").withColumn("part", F.coalesce("part", "doc_id"))
    known = common.materialize(known, "parts")
    by_part = known.groupBy("grp", "n", "part").agg(F.count("*").alias("m"), F.sum("size").alias("shingles"))
    main = by_part.groupBy("grp", "n").agg(F.max_by("part", F.struct("m", "part")).alias("main"), (F.sum("m") - F.max("m")).alias("rest"), (F.sum("shingles") - F.max_by("shingles", F.struct("m", "part"))).alias("shingles"))
    main = main.where("rest > 0").select("grp", "main", F.greatest(F.lit(1), _chunks(F.col("rest"), F.col("shingles"), F.col("n"))).alias("rows"))
    main = common.materialize(main, "main")
    held = known.select("grp", "doc_id", "part").join(main, "grp").select("grp", "doc_id", "rows", (F.col("part") != F.col("main")).alias("apart")).dropDuplicates(["grp", "doc_id"])
    held = common.materialize(held, "apart")
    others = members.join(held, ["grp", "doc_id"])
    apart = others.where("apart").withColumn("row", _chunk(F.col("doc_id"), F.col("rows")))
    # Chunks of the rest are numbered from -1 down; block (ci, cj) holds the rest's chunk ci and the members' chunk cj.
    a = apart.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("cj")).withColumn("ci", -1 - F.col("row")).withColumn("chunk", F.col("ci"))
    b = others.where("not apart").withColumn("cj", F.col("chunk")).select("*", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row")).withColumn("ci", -1 - F.col("row"))
    # Within the rest, every pair of its chunks.
    pair = apart.select("*", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("other"))
    c = pair.withColumn("ci", -1 - F.least("row", "other")).withColumn("cj", -1 - F.greatest("row", "other")).withColumn("chunk", -1 - F.col("row"))
    names = [x.split()[0] for x in MEMBERS.split(", ")]
    return common.materialize(_compare(a.select(*names).unionByName(b.select(*names)).unionByName(c.select(*names))), "rest_links")


def deduplicate(docs: DataFrame) -> DataFrame:
    """Rows of docs, as they are, that are kept: one document of each component. Of equal doc_ids all rows stay or go."""
    gone = components(docs).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")
