"""Language ID from averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its hashed byte 3- and 4-grams, taken over letters only. Embeddings and the
softmax layer are trained together by stochastic gradient descent in numpy on the driver, over a bounded sample of
labelled rows. Scores are calibrated by a temperature, and the rejection threshold is the score that all but a stated
share of correctly labelled held-back rows reach.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .texthash import SMALL, blocks

BUCKETS = 1 << 15
DIM = 16
#: Bound of the training sample: rows in all, taken evenly by language and by a hash of the id, each as its hashed grams.
SAMPLE_ROWS = 1600
PREDICTED = "doc_id long, lang_pred string, score double, rejected boolean"
_LETTERS = bytes(97 + (c - 65) if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # buckets x languages: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float


def _grams(run: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each 3-gram and 4-gram start, whether it counts, text ends) of a block; lower case, letters only. Every
    text has a blank of its own on both sides, so that no gram that counts reaches into another text."""
    b = np.frombuffer(b" " + b"  ".join(run) + b"    ", dtype=np.uint8).astype(np.uint32)
    n = len(b) - 4
    h3 = b[:n] * np.uint32(0x9E3779B1) + b[1 : n + 1] * np.uint32(0x85EBCA6B) + b[2 : n + 2] * np.uint32(0xC2B2AE35)
    h4 = h3 + b[3 : n + 3] * np.uint32(0x27D4EB2F) + np.uint32(0x165667B1)
    idx = np.empty((2, n), dtype=np.int32)
    for k, h in enumerate((h3, h4)):
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        idx[k] = h >> np.uint32(32 - int(math.log2(BUCKETS)))
    ok = b[1 : n + 1] != 32  # the middle of a 3-gram is a letter
    return idx, ok, np.cumsum([len(t) + 2 for t in run])


def letters(text: str) -> bytes:
    return text.lower().encode().translate(_LETTERS)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their share of the text's grams."""
    idx, ok, _ = _grams([letters(text)])
    b, c = np.unique(idx[:, ok], return_counts=True)
    return b.astype(np.int32), (c / max(1, c.sum())).astype(np.float32)


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(lang, buckets, shares as raw bytes): at most rows labelled rows with a letter, evenly by language, by a hash of the id."""
    known = docs.where("lang is not null and text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    counts = known.groupBy("lang").count().collect()  # one row a language
    if not counts:
        return known.select("lang", F.lit(b"").alias("buckets"), F.lit(b"").alias("shares"))
    each = max(1, rows // len(counts))
    share = F.create_map(*[x for r in counts for x in (F.lit(r[0]), F.lit(min(1.0, (1.2 * each + 6 * math.sqrt(each)) / r[1])))])
    place = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1_000_003))
    few = known.where(place < share[F.col("lang")] * 1_000_003)  # somewhat more than each of a language
    first = F.row_number().over(Window.partitionBy("lang").orderBy(place, "doc_id", F.xxhash64("text")))
    few = few.withColumn("nth", first).where(F.col("nth") <= each).select("lang", "text")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [features(t) for t in common.texts_of(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array([x.tobytes() for x, _ in f], pa.binary()), pa.array([y.tobytes() for _, y in f], pa.binary())], names=["lang", "buckets", "shares"])

    return few.mapInArrow(grams, "lang string, buckets binary, shares binary")


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, epochs: int = 6, rate: float = 0.2, lost: float = 0.002, seed: int = 7) -> Model | None:
    """A model from rows of docs with a language; None if there is none. lost: share of right held-back rows that the
    threshold may reject; it is 1.5 times the chance of one language at most, so that a model that is sure of everything
    still keeps texts that it only leans on."""
    got = sample(docs, rows).collect()  # bounded by rows
    got = [(r["lang"], np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["shares"], np.float32)) for r in got if r["buckets"]]
    got.sort(key=lambda x: (x[0], len(x[1]), x[1][:8].tolist()))
    if not got:
        return None
    langs = sorted({x[0] for x in got})
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(got))
    held = {int(i) for i in order[: len(got) // 5]} if len(got) >= 10 * len(langs) else set()
    emb = np.zeros((BUCKETS, DIM), np.float32)
    out, bias = rng.normal(0, 1, (DIM, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    train = [i for i in order.tolist() if i not in held]
    steps, step = epochs * len(train), 0
    for _ in range(epochs):
        for i in rng.permutation(train):
            lang, b, w = got[i]
            h = w @ emb[b]
            z = h @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[langs.index(lang)] -= 1
            a = np.float32(rate * (1 - step / steps))
            down = out @ p
            out -= a * np.outer(h, p)
            bias -= a * np.float32(0.01) * p
            emb[b] -= (a * w / np.float32((w * w).sum()))[:, None] * down[None, :]
            step += 1
    table = emb @ out
    check = sorted(held) or train
    z = np.stack([got[i][2] @ table[got[i][1]] + bias for i in check]).astype(float)
    y = np.array([langs.index(got[i][0]) for i in check])

    def loss(t: float) -> float:
        s = z / t
        s -= s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]))

    temperature = min(np.geomspace(0.2, 5, 33).tolist(), key=loss)
    s = z / temperature
    p = np.exp(s - s.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    right = p.max(1)[p.argmax(1) == y]
    threshold = min(1.5 / max(2, len(langs)), float(np.quantile(right, lost))) if len(right) else 0.0
    return Model(langs, table.astype(np.float32), bias, temperature, threshold)


def score(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Predicted language and calibrated probability of each whole text; und and 0 where no letter is."""
    z = np.zeros((len(texts), len(model.langs)))
    lettered = np.array([has_letter(t) for t in texts], dtype=bool)
    for first, run in blocks([letters(t) for t in texts], SMALL):
        idx, ok, ends = _grams(run)
        hits = np.concatenate([[0], np.cumsum(ok)])[np.minimum(ends, len(ok))]
        for j in range(len(model.langs)):
            col = model.table[:, j].astype(np.float64)
            sums = np.concatenate([[0.0], np.cumsum(np.where(ok, col[idx[0]] + col[idx[1]], 0.0))])[np.minimum(ends, len(ok))]
            total = np.diff(sums, prepend=0.0)
            z[first : first + len(run), j] = total / np.maximum(1, 2 * np.diff(hits, prepend=0))
    z = (z + model.bias) / model.temperature
    p = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
    p = p / p.sum(1, keepdims=True) if len(z) else z
    best = p.argmax(1) if len(z) else []
    return [model.langs[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], np.where(lettered, p.max(1) if len(z) else 0.0, 0.0)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of each whole text.

    Null text, or text without a letter: und, 0, rejected. Without a model every text is und. Of languages that score
    alike the first by name wins. Repeated rows stay; an empty table gives an empty table; other columns are ignored.
    """
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.in_slices(batches):
            texts = common.texts_of(b.column("text"))
            langs, p = score(model, texts) if model and texts else (["und"] * len(texts), np.zeros(len(texts)))
            bad = [x == "und" or s < model.threshold for x, s in zip(langs, p, strict=True)] if model else [True] * len(texts)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(langs, pa.string()), pa.array(np.asarray(p, dtype=float)), pa.array(bad, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return kept.mapInArrow(rows, PREDICTED)


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """Rows of docs, as they are, whose text the model doesn't reject; without a model nothing is judged and all stay."""
    if model is None:
        return docs
    at = docs.columns.index("text")
    names = docs.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.in_slices(batches):
            if b.num_rows:
                langs, p = score(model, common.texts_of(b.column(at)))
                b = b.filter(pa.array([x != "und" and s >= model.threshold for x, s in zip(langs, p, strict=True)], pa.bool_()))
            yield b

    return docs.select(*names).mapInArrow(rows, docs.schema)
