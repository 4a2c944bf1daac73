"""Document fingerprints by quartile bucket digest.

Every byte triplet of a text is hashed to one of 128 buckets. A bucket's place among the quartiles of all bucket counts
takes two bits; the text's length on a logarithmic scale takes one byte. The difference of two digests adds, per bucket,
0 to 3 quartiles (opposite ends count double) and a bounded length term; likeness is 1 - difference / largest difference.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 128
_LENGTH_MOST, _FAR = 24, 6
MOST = BUCKETS * _FAR + _LENGTH_MOST
_GAP_COST = np.array([0, 1, 2, _FAR], dtype=np.int64)
_BLOCK = 1 << 20
EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_HELD = "pid int, kind int, text string"


def digest(raw: bytes) -> bytes:
    """One length byte and the bucket quartiles, four to a byte. Fewer than three bytes: all buckets are 0."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    buf = np.frombuffer(raw, dtype=np.uint8)
    for lo in range(0, len(buf) - 2, _BLOCK):
        b = buf[lo : lo + _BLOCK + 2].astype(np.uint32)
        h = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        counts += np.bincount((h >> np.uint32(25)).astype(np.intp), minlength=BUCKETS)
    cuts = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    q = (counts > cuts[0]).astype(np.uint8) + (counts > cuts[1]) + (counts > cuts[2])
    packed = q[0::4] | q[1::4] << 2 | q[2::4] << 4 | q[3::4] << 6
    return bytes([min(255, round(8 * math.log2(len(raw) + 1)))]) + packed.astype(np.uint8).tobytes()


def _quartiles(fp: bytes) -> np.ndarray:
    p = np.frombuffer(fp, dtype=np.uint8)[1:]
    return np.stack([p >> s & 3 for s in (0, 2, 4, 6)]).astype(np.int64)


def likeness(a: bytes, b: bytes) -> float:
    """1 for equal digests, 0 for the largest difference."""
    if a == b:
        return 1.0
    return 1 - (int(_GAP_COST[np.abs(_quartiles(a) - _quartiles(b))].sum()) + min(_LENGTH_MOST, abs(a[0] - b[0]))) / MOST


def edit(text: str, after: str) -> str:
    """text with its last half (rounded down) replaced by as many first code points of the next text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of each row's whole text, in hexadecimal. Null text is empty; nothing else is dropped."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.in_slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([digest(t.encode()).hex() for t in common.texts_of(b.column("text"))], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, fingerprint string")


def _row(doc, text: str, fp: bytes, after: str, after_fp: bytes) -> tuple:
    new = edit(text, after).encode()
    new_fp = digest(new)
    return doc, len(text), hashlib.sha256(new).hexdigest(), fp.hex(), new_fp.hex(), likeness(fp, new_fp), likeness(fp, after_fp)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    cols = [x.split() for x in schema.split(", ")]
    data = list(zip(*rows, strict=True)) if rows else [()] * len(cols)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(data, cols, strict=True)], names=[n for n, _ in cols])


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint, that of its edited text, and its likeness to that and to the next row's fingerprint.

    Rows follow each other by descending doc_id, null ids last and equal ids by text; the first follows the last, so a
    single row follows itself. Null text is empty. An empty table gives an empty table. One range exchange puts rows in
    order; a task keeps one row at a time, and hands its first and last row on to its neighbours.
    """
    schema = f"{_HELD}, {EDITED}"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, held = TaskContext.get().partitionId(), None
        for b in common.in_slices(batches):
            out = []
            for doc, text in zip(b.column("doc_id").to_pylist(), common.texts_of(b.column("text")), strict=True):
                fp = digest(text.encode())
                if held is None:
                    out.append((pid, 1, text, doc, *[None] * 6))
                else:
                    out.append((pid, 0, None, *_row(*held, text, fp)))
                held = doc, text, fp
            yield _batch(out, schema)
        if held is not None:
            yield _batch([(pid, 2, held[1], held[0], *[None] * 6)], schema)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch([_row(d, t, digest(t.encode()), a, digest(a.encode())) for d, t, a in zip(b.column("doc_id").to_pylist(), common.texts_of(b.column("text")), common.texts_of(b.column("after")), strict=True)], EDITED)

    # The text's beginning is part of the range, so that rows of one id (or none) spread over tasks.
    begins = F.substring("text", 1, 32).asc_nulls_first()
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(F.col("doc_id").desc_nulls_last(), begins).sortWithinPartitions(F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())
    done = common.materialize(ordered.mapInArrow(rows, schema), "rows")
    edge = done.where("kind > 0")
    pids = sorted(r[0] for r in edge.where("kind = 1").select("pid").collect())  # one number a task
    follow = docs.sparkSession.createDataFrame([(p, q) for p, q in zip(pids, pids[1:] + pids[:1], strict=True)], "pid int, head int")
    heads = edge.where("kind = 1").select(F.col("pid").alias("head"), F.col("text").alias("after"))
    joined = edge.where("kind = 2").select("pid", "doc_id", "text").join(follow, "pid").join(heads, "head").select("doc_id", "text", "after")
    names = [x.split()[0] for x in EDITED.split(", ")]
    return done.where("kind = 0").select(*names).unionByName(joined.mapInArrow(ends, EDITED))
