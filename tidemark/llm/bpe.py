"""Byte-level BPE encoding and decoding by overlapping chunks.

A long text is cut into chunks that overlap. Every chunk is pre-tokenised on its own, in parallel. The pattern looks
back at nothing, so once two runs over the same characters share a boundary, all their later boundaries agree: the
chunks are stitched at the first shared boundary of each overlap that doesn't follow white space (which the pattern
joins differently at a text's end), and the pieces between stitches are encoded. Where an overlap holds no such boundary (one huge run of letters or blanks), the text is pre-tokenised on from the last
sure one, twice as far each time, so that the time stays linear in the run.
Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CHUNK, OVERLAP, LONG = 32_768, 1_024, 131_072
#: Code points before a chunk's end in which a boundary may still move; longer than the pattern's longest fixed word.
MARGIN = 8
_CACHE: dict = {}
_KINDS = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
ENCODED = "doc_id long, ids array<int>"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Codec:
    """Encoder and decoder of one rank file and one pre-tokenisation pattern."""

    def __init__(self, ranks: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.names = [str(i) for i in range(max(table.values()) + 1)]

    def boundaries(self, text: str) -> list[int]:
        """Ends of the pre-tokens."""
        return [m.end() for m in self.pattern.finditer(text)]

    def encode(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        if len(text) <= chunk + overlap:
            return self.core.encode_ordinary(text)
        starts = range(0, len(text), chunk)
        cuts = [self.boundaries(text[s : s + chunk + overlap]) for s in starts]
        return self.encode_pieces(text, stitch(self, text, list(starts), cuts, chunk, overlap))

    def encode_pieces(self, text: str, cuts: list[int]) -> list[int]:
        out: list[int] = []
        for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True):
            out += self.core.encode_ordinary(text[a:b])
        return out

    def decode(self, ids: list[int]) -> bytes:
        return self.core.decode_bytes(ids)

    def digest(self, ids: list[int]) -> tuple[int, str, str]:
        names = self.names
        return len(ids), hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


def stitch(codec: Codec, text: str, starts: list[int], cuts: list[list[int]], chunk: int, overlap: int) -> list[int]:
    """Positions of the text at which chunks hand over. cuts: each chunk's boundaries, from its own start."""
    out: list[int] = []
    begin, own, last, reach = starts[0], cuts[0], 0, starts[0] + chunk + overlap
    for s, later in zip(starts[1:], cuts[1:], strict=True):
        left = _sure(begin, own, len(text))
        shared = [x for x in sorted(left & _sure(s, later, len(text))) if max(s, last) < x <= s + overlap and not text[x - 1].isspace()]
        if shared:
            last = shared[0]
            out.append(last)
            begin, own, reach = s, later, s + chunk + overlap
        elif reach < min(len(text), s + chunk + overlap):  # one run fills the overlap: carry on from the last sure boundary
            begin = max((x for x in left if x > last), default=max(begin, last))
            reach = max(s + chunk + overlap, begin + 2 * (reach - begin))
            own = codec.boundaries(text[begin:reach])
    return out


def _sure(begin: int, cuts: list[int], end: int) -> set[int]:
    """Boundaries that more text can't change: the last pre-token may be cut off, and so may the pattern's short words."""
    if not cuts or begin + cuts[-1] == end:
        return {begin + x for x in cuts}
    return {begin + x for x in cuts[:-1] if x <= cuts[-1] - MARGIN}


def codec_of(ranks: str, pattern: str) -> Codec:
    return common.worker_cache(_CACHE, (ranks, pattern), lambda: Codec(ranks, pattern))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _encoded(docs: DataFrame, ranks: str, pattern: str, finish, schema: str) -> DataFrame:
    """finish(codec, ids) makes the columns after doc_id."""
    fields = [f.split(" ", 1) for f in schema.split(", ")]
    names, kinds = [n for n, _ in fields], [_KINDS[k] for _, k in fields]

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(ranks, pattern)
        for b in common.in_slices(batches):
            rows = [finish(codec, codec.encode(t)) for t in common.texts_of(b.column("text"))]
            cols = list(zip(*rows, strict=True)) if rows else [()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds[1:], strict=True)]], names=names)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = codec_of(ranks, pattern)
        for f in frames:
            f["cuts"] = [np.asarray(codec.boundaries(t), dtype=np.int32).tobytes() for t in f["part"]]
            yield f

    def join(key, f: pd.DataFrame) -> pd.DataFrame:
        codec = codec_of(ranks, pattern)
        f = f.sort_values("k")
        parts = f["part"].tolist()
        text = "".join(p[:CHUNK] for p in parts[:-1]) + parts[-1]
        cuts = [np.frombuffer(c, dtype=np.int32).tolist() for c in f["cuts"]]
        ids = codec.encode_pieces(text, stitch(codec, text, [k * CHUNK for k in f["k"]], cuts, CHUNK, OVERLAP))
        return pd.DataFrame([(f["doc_id"].iloc[0], *finish(codec, ids))], columns=names).astype({"doc_id": "Int64"})

    texts = _texts(docs)
    done = texts.where(F.length("text") <= LONG).mapInArrow(short, schema)
    long = texts.where(F.length("text") > LONG).withColumn("row", F.monotonically_increasing_id())
    parts = long.select("row", "doc_id", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / CHUNK).cast("int"))).alias("k"), "text")
    parts = parts.select("row", "doc_id", "k", F.substring("text", F.col("k") * CHUNK + 1, F.lit(CHUNK + OVERLAP)).alias("part")).repartition("row", "k")
    parts = parts.mapInPandas(cut, "row long, doc_id long, k int, part string, cuts binary")
    return done.unionByName(parts.groupBy("row").applyInPandas(join, schema))


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of each row's whole text. Null text is empty and gives no ids; repeated rows stay repeated; an empty
    table gives an empty table; columns other than doc_id and text are ignored."""
    return _encoded(docs, ranks, pattern, lambda codec, ids: (ids,), ENCODED)


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, bytes): the raw bytes of the ids, one after the other; null ids count as none."""

    def rows(batches):
        codec = codec_of(ranks, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([codec.decode(x or []) for x in b.column("ids").to_pylist()], pa.binary())], names=["doc_id", "bytes"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(rows, "doc_id long, bytes binary")


def digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode and decode each whole text; edge cases as in encode."""
    return _encoded(docs, ranks, pattern, lambda codec, ids: codec.digest(ids), DIGEST)
