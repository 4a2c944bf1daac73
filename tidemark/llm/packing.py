"""Best-fit packing by minimum bin slack.

Only the number of pieces of each length (at most ``cap`` numbers, however many documents) reaches the driver. For each
bin, a bitset subset-sum over the lengths left finds the fullest combination that holds the longest one; that
combination is removed as often as its lengths last, which is what bin-by-bin removal would do. Pieces then find their
bin from their rank among pieces of equal length, which is a prefix sum over (task, length) counts.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

CAP = 2048
#: Words whose ids a worker keeps; beyond that, words are encoded but not kept. Results don't depend on it.
KEPT_WORDS = 300_000
#: Words given to the library in one call; its encodings take about 1 kB a word until the call's ids are taken from them.
AT_ONCE = 5_000
_END = b"\xff"
_CACHE: dict = {}
_RANK_BITS = 44
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"


# The parts of a tokenizer file under which words can be encoded on their own.
NORMALIZERS = ("NFC", "Replace", "Lowercase")
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"


def _by_words(path: str) -> bool:
    """Whether a tokenizer file folds white space, lower-cases, splits words as PRE_TOKENS and marks their ends."""
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    norm, pre, model = (t.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    splits = pre.get("pretokenizers") or [{}]
    return tuple(x.get("type") for x in norm.get("normalizers", ())) == NORMALIZERS and splits[0].get("pattern") == {"Regex": PRE_TOKENS} and [x.get("type") for x in splits] == ["Split", "ByteLevel"] and model.get("type") == "BPE" and model.get("end_of_word_suffix") == WORD_END


class WordEncoder:
    """Ids of whole texts; words between white space are encoded once and kept, since pre-tokens never span white space.
    A tokenizer of another kind encodes every text as a whole."""

    def __init__(self, path: str):
        common.cpu_quiet()
        from tokenizers import Tokenizer

        self.core = Tokenizer.from_file(path)
        self.core.encode_special_tokens = True
        self.kept: dict[str, bytes] = {}
        self.by_words = _by_words(path)
        if not self.by_words:
            return
        self.merge = _merger(self.core.get_vocab(with_added_tokens=False))
        self.marks = {c: self.plain(c) for c in ".,"}

    def plain(self, text: str) -> bytes:
        return np.asarray(self.core.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each word. Words of Latin letters, with one full stop or comma after them at most, are merged by rank
        (the vocabulary's ids are in the order of its merges); all others go to the library as they are."""
        out, rest, merge = {}, [], self.merge
        for w in words:
            body, end = (w[:-1], self.marks[w[-1]]) if w[-1] in self.marks else (w, b"")
            if body.isalpha() and max(body) <= "\u00ff":
                out[w] = array("I", merge(body.lower().encode() + _END)).tobytes() + end
            else:
                rest.append(w)
        for w, e in zip(rest, self.core.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            out[w] = array("I", e.ids).tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.by_words:
            return [self.plain(t) for t in texts]
        kept = self.kept
        split = [None if _odd_space(t) else t.split() for t in texts]
        new = list({w for words in split if words for w in words if w not in kept})
        fresh: dict[str, bytes] = {}
        for i in range(0, len(new), AT_ONCE):
            fresh |= self.learn(new[i : i + AT_ONCE])
        if len(kept) + len(fresh) <= KEPT_WORDS:
            kept.update(fresh)
            fresh = {}
        elif len(kept) < KEPT_WORDS:
            kept.update(list(fresh.items())[: KEPT_WORDS - len(kept)])
        find, rest = kept.get, fresh.get
        return [self.plain(t) if words is None else b"".join([find(w) or rest(w, b"") for w in words]) for t, words in zip(texts, split, strict=True)]


def _merger(vocab: dict[str, int]):
    """Byte-pair merging of one word's bytes plus _END, which stands for the vocabulary's word end."""
    import tiktoken
    from tokenizers.pre_tokenizers import ByteLevel

    level = ByteLevel(add_prefix_space=False, use_regex=False)
    byte_of = {}
    for c in map(chr, range(0x800)):
        for shown, raw in zip(level.pre_tokenize_str(c)[0][0], c.encode(), strict=True):
            byte_of[shown] = raw
    ranks = {_END: max(vocab.values()) + 1}
    for token, i in vocab.items():
        body = token.removesuffix("</w>") or token
        if all(c in byte_of for c in body) and (key := bytes(byte_of[c] for c in body) + _END * (body != token)) != _END:
            ranks[key] = i
    for b in range(256):
        ranks.setdefault(bytes([b]), ranks[_END] + 1 + b)  # bytes that no UTF-8 text has
    return tiktoken.Encoding("words", pat_str="x", mergeable_ranks=ranks, special_tokens={}, explicit_n_vocab=None)._core_bpe.encode_single_piece


def _odd_space(text: str) -> bool:
    """Whether Python's white space differs from the tokenizer's in this text."""
    return any(c in text for c in "\x1c\x1d\x1e\x1f")


def encoder_of(path: str) -> WordEncoder:
    return common.worker_cache(_CACHE, path, lambda: WordEncoder(path))


def plan(counts: dict[int, int], cap: int = CAP) -> list[tuple[dict[int, int], int]]:
    """[(pieces of each length in a bin, number of such bins)]. At most about cap * ln(cap) entries for any input: every
    entry leaves one of its lengths with fewer pieces than a bin of its kind takes."""
    left = {n: c for n, c in counts.items() if c > 0}
    order = sorted(left, reverse=True)
    out = []
    while left:
        top = next(n for n in order if n in left)
        if len(order) > 2 * len(left):
            order = [n for n in order if n in left]
        room, reach, layers = cap - top, 1, []
        for n in order:
            if n > room or n not in left:
                continue
            c = min(left[n] - (n == top), room // n)
            if c <= 0:
                continue
            layers.append((n, reach))
            k = 1
            while c > 0:
                t = min(k, c)
                reach |= reach << (t * n)
                c -= t
                k *= 2
            reach &= (2 << room) - 1
            if reach >> room:
                break
        full, bin_ = reach.bit_length() - 1, {top: 1}
        for n, before in reversed(layers):
            while not before >> full & 1:
                full -= n
                bin_[n] = bin_.get(n, 0) + 1
        times = min(left[n] // m for n, m in bin_.items())
        for n, m in bin_.items():
            left[n] -= times * m
            if not left[n]:
                del left[n]
        out.append((bin_, times))
    return out


def slots(bins: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For each (bin kind, length), ordered by length and rank: first rank, pieces per bin, first bin and offset."""
    rows, used, first = [], {}, 0
    for bin_, times in bins:
        at = 0
        for n in sorted(bin_, reverse=True):
            rows.append((n, used.get(n, 0), bin_[n], first, at))
            used[n] = used.get(n, 0) + times * bin_[n]
            at += n * bin_[n]
        first += times
    t = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return {"key": (t[:, 0] << _RANK_BITS) + t[:, 1], "each": t[:, 2], "bin": t[:, 3], "offset": t[:, 4]}


def pieces(docs: DataFrame, tokenizer: str, cap: int = CAP) -> DataFrame:
    """Each document's pieces with their rank among the task's pieces of that length."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen, encoder = TaskContext.get().partitionId(), np.zeros(cap + 1, dtype=np.int64), encoder_of(tokenizer)
        for b in common.in_slices(batches):
            out: list[tuple] = []
            ids_of = common.texts_of(b.column("text"))
            for lo in range(0, len(ids_of), 500):
                for doc, ids in zip(b.column("doc_id")[lo : lo + 500].to_pylist(), encoder.encode(ids_of[lo : lo + 500]), strict=True):
                    ids += b"\0\0\0\0"
                    for k, a in enumerate(range(0, len(ids), 4 * cap)):
                        part = ids[a : a + 4 * cap]
                        n = len(part) // 4
                        out.append((doc, k, a // 4, n, zlib.crc32(part), task, int(seen[n])))
                        seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, PIECES)


def pack(docs: DataFrame, tokenizer: str, cap: int = CAP) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece; one id 0 ends each document.

    Null text is an empty document (its only id is the 0). Null or repeated doc_ids are packed like any other row. An
    empty table gives an empty table. Columns other than doc_id and text are ignored.
    """
    cut = common.materialize(pieces(docs, tokenizer, cap), "pieces")
    by_task = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    table = slots(plan({int(n): int(c) for n, c in cut.groupBy("length").count().collect()}, cap))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = by_task.select("task", "length", F.coalesce(before, F.lit(0)).alias("before"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n = length.to_numpy()
        i = np.searchsorted(table["key"], (n << _RANK_BITS) + rank.to_numpy(), side="right") - 1
        k = rank.to_numpy() - (table["key"][i] & ((1 << _RANK_BITS) - 1))
        return pd.DataFrame({"sequence_id": table["bin"][i] + k // table["each"][i], "offset": table["offset"][i] + k % table["each"][i] * n})

    ranked = cut.join(starts, ["task", "length"]).withColumn("place", place("length", F.col("rank") + F.col("before")))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")
