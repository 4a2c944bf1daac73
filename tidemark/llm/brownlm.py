"""LM scoring with Brown class-based n-grams.

Words are 64-bit hashes, counted exactly over all training text. The core, the most frequent words by these counts, is
assigned to CLASSES classes by exchange clustering on its bigrams; its size grows with the vocabulary. Every other
training word is placed in the class that its counts with the classes before and after it fit best, by a shuffle on its
hash. Words without training text share one class, text ends another. The model's score is the sum of log10
P(class | class before) and log10 P(word | class), smoothed by adding 0.5. A bounded set of frequent words (HOT, picked
from a bounded sample; it only decides where a word is looked up) gets its class in place; every other word, however
many there are, gets it by a join on its hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .texthash import blocks, mix, words_of_block

HOT, CLUSTERED, CLASSES, SWEEPS = 1 << 18, 1024, 32, 6
#: Core words per cube root of the vocabulary, CLUSTERED at least.
GROWTH = 12
#: Words that a task holds before it passes their counts on.
HELD = 1 << 21
#: Rows of the sample that picks the hot words.
SAMPLE_ROWS = 20_000
ADD = 0.5
PAIR = np.dtype([("d", "u1"), ("n", "<u4")])
TOKENS = "row long, h long, pos binary, head boolean, doc_id long, held_out boolean, seq binary, n_known long, logs double"
SEQS = "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, seq binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@dataclass
class Model:
    """Classes of all training words. words: core and hot words, sorted; placed: (h, c, cls) of words outside the core."""

    words: np.ndarray
    counts: np.ndarray
    cls: np.ndarray  # class of each of words; CLASSES is the class of words without training text
    placed: DataFrame
    sizes: np.ndarray  # tokens of each class
    kinds: np.ndarray  # words of each class
    ends: int


def _rows(docs: DataFrame) -> DataFrame:
    fold = common.crc_fold(F.col("doc_id"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(fold == 1, F.lit(False)).alias("held_out"))


def hot_words(docs: DataFrame, rows: int = SAMPLE_ROWS, hot: int = HOT) -> np.ndarray:
    """Hashes of the sample's most frequent words, most frequent first."""

    def count(batches):
        for b in common.in_slices(batches):
            got = [np.unique(words_of_block(run)[0], return_counts=True) for _, run in blocks([t.encode() for t in common.texts_of(b.column("text"))])]
            if got:
                h, c = (np.concatenate(x) for x in zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])

    n = docs.count()
    train = _rows(docs).where("not held_out")
    if n > rows:
        train = train.where(F.pmod(F.xxhash64("doc_id", F.lit("hot")), F.lit(1_000_003)) < int(1_000_003 * rows / n))
    seen = common.materialize(train.mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "sample_counts")
    steps = sorted((r[0], r[1]) for r in seen.groupBy(F.floor(F.log2("c") * 8).alias("k")).count().collect())
    least, total = 1 << 62, 0
    for k, m in reversed(steps):
        if total + m > hot:
            break
        least, total = k, total + m
    h, c = _numbers(seen.where(F.floor(F.log2("c") * 8) >= least), "h", "c")  # at most hot rows
    return h[np.lexsort((h, -c))].view(np.uint64)


def _numbers(df: DataFrame, *columns: str) -> list[np.ndarray]:
    """Long columns of a bounded frame."""
    table = df.select(*columns).toArrow()
    return [table.column(c).to_numpy().astype(np.int64) for c in columns]


def _lookup(hot: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Place of each word in hot (sorted), or -1."""
    if not len(hot):
        return np.full(len(words), -1, dtype=np.int64)
    at = np.searchsorted(hot, words)
    at[at == len(hot)] = 0
    return np.where(hot[at] == words, at, -1)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in common.in_slices(batches):
        for _, run in blocks([t.encode() for t in common.texts_of(b.column("text"))]):
            yield words_of_block(run)


def _in_heaps(parts: Iterator[tuple[np.ndarray, ...]], size: int = HELD) -> Iterator[tuple[np.ndarray, ...]]:
    """Parts joined until they have size entries."""
    held, n = [], 0
    for p in parts:
        held.append(p)
        n += len(p[0])
        if n >= size:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _binary(lengths: np.ndarray, data: bytes) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32).tobytes()), pa.py_buffer(data)])


def count_words(docs: DataFrame) -> DataFrame:
    """(h, c): exact count of every training word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (words,) in _in_heaps((w,) for w, _ in _runs(batches)):
            h, c = np.unique(words, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])

    return _rows(docs).where("not held_out").select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def core_bigrams(docs: DataFrame, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, count) of all training bigrams; words outside the core (sorted) are one word, ends another."""
    k = len(core)
    side = k + 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def codes() -> Iterator[tuple[np.ndarray, ...]]:
            for words, upto in _runs(batches):
                at = _lookup(core, words)
                ids = np.insert(np.where(at >= 0, at, k), upto, k + 1)
                yield (np.concatenate([[k + 1], ids[:-1]]) * side + ids,)

        for (x,) in _in_heaps(codes()):
            p, c = np.unique(x, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(c.astype(np.int64))], names=["k", "c"])

    got = _rows(docs).where("not held_out").select("text").mapInArrow(count, "k long, c long").groupBy("k").agg(F.sum("c").alias("c"))
    keys, c = _numbers(got, "k", "c")  # pairs of core words that occur
    order = np.argsort(keys)
    return keys[order] // side, keys[order] % side, c[order]


def place(docs: DataFrame, core: np.ndarray, of: np.ndarray, table: np.ndarray, hot: np.ndarray) -> DataFrame:
    """(h, c, cls, is_hot) of every training word outside the core.

    A word's class is that with the largest sum, over all its neighbours, of how much more often the class stands beside
    the neighbour's class than chance (table: class bigrams of the core). Sums are of whole numbers, so order is free.
    """
    n = len(table)
    classes = n - 2
    rows, cols = table.sum(1) + ADD * n, table.sum(0) + ADD * n
    fit = np.log((table + ADD) / rows[:, None] / cols[None, :])
    some = np.unique(of[: len(core)])
    weights = np.round(np.concatenate([fit, fit.T])[:, some] * (1 << 16))

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple[np.ndarray, ...]]:
            for words, upto in _runs(batches):
                at = _lookup(core, words)
                seq = np.insert(np.where(at >= 0, of[at], classes), upto, n - 1)
                is_word = np.ones(len(seq), dtype=bool)
                is_word[upto + np.arange(len(upto))] = False
                i = np.flatnonzero(is_word)[at < 0]
                h = words[at < 0]
                before, after = np.where(i > 0, seq[i - 1], n - 1), seq[i + 1]
                yield np.concatenate([h, h]), np.concatenate([before, after + n]).astype(np.uint8)

        for h, d in _in_heaps(pairs()):
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]))
            out = np.empty(len(first), dtype=PAIR)
            out["d"], out["n"] = d[first], np.diff(np.append(first, len(h)))
            own, size = np.unique(h[first], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), _binary(size * PAIR.itemsize, out.tobytes())], names=["h", "p"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.in_slices(batches, 8192):
            lists = b.column("p")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            parts = lists.flatten().to_pylist()
            got = np.frombuffer(b"".join(parts), dtype=PAIR)
            word = np.repeat(np.repeat(np.arange(b.num_rows), sizes), [len(x) // PAIR.itemsize for x in parts])
            near = np.bincount(word * (2 * n) + got["d"], weights=got["n"], minlength=b.num_rows * 2 * n).reshape(-1, 2 * n)
            cls = some[(near @ weights).argmax(1)]
            h = b.column("h").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.array(near[:, :n].sum(1).astype(np.int64)), pa.array(cls.astype(np.int32)), pa.array(_lookup(hot, h.view(np.uint64)) >= 0)], names=["h", "c", "cls", "is_hot"])

    got = _rows(docs).where("not held_out").select("text").mapInArrow(beside, "h long, p binary").groupBy("h").agg(F.collect_list("p").alias("p"))
    return common.materialize(got.mapInArrow(choose, "h long, c long, cls int, is_hot boolean"), "placed")


def train(docs: DataFrame, hot_ranked: np.ndarray, clustered: int = CLUSTERED, classes: int = CLASSES) -> Model:
    """Exact counts and a class for every training word."""
    words = common.materialize(count_words(docs), "words")
    ends, kinds = _rows(docs).where("not held_out").count(), words.count()
    h, c = _numbers(words.orderBy(F.desc("c"), "h").limit(max(clustered, int(GROWTH * kinds ** (1 / 3)))), "h", "c")
    ranked = h.view(np.uint64)
    # Exchange starts from classes dealt by frequency, so bigrams are numbered by rank.
    order = np.argsort(ranked, kind="stable")
    core, rank, core_counts = ranked[order], order, c[order]
    a, b, n_ab = core_bigrams(docs, core)
    to_rank = np.concatenate([rank, [len(core), len(core) + 1]])
    by_rank = exchange_sparse(len(core) + 2, to_rank[a], to_rank[b], n_ab, classes)
    of = by_rank[to_rank]
    n = classes + 2
    table = np.zeros((n, n))
    np.add.at(table, (of[a], of[b]), n_ab)
    hot = np.unique(np.concatenate([hot_ranked, core]))
    counts, cls = np.zeros(len(hot), dtype=np.int64), np.full(len(hot), classes)
    at = _lookup(hot, core)
    counts[at], cls[at] = core_counts, of[: len(core)]
    sizes = np.bincount(cls, weights=counts, minlength=n)
    sizes[classes] = 0
    kinds_of = np.bincount(of[: len(core)], minlength=n)
    if kinds > len(core):
        placed = place(docs, core, of, table, hot)
        for x, m, t in placed.groupBy("cls").agg(F.count("*"), F.sum("c")).collect():  # one row a class
            kinds_of[x] += m
            sizes[x] += t
        h, c, x = _numbers(placed.where("is_hot"), "h", "c", "cls")  # at most hot words
        at = _lookup(hot, h.view(np.uint64))
        counts[at], cls[at] = c, x
        placed = placed.where("not is_hot").select("h", "c", "cls")
    else:
        placed = words.limit(0).select("h", "c", F.lit(0).alias("cls"))
    return Model(hot, counts, cls, placed, sizes, kinds_of, ends)


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """exchange_sparse of a full table of bigrams."""
    a, b = np.nonzero(bigrams)
    return exchange_sparse(len(bigrams), a, b, bigrams[a, b], classes, sweeps)


def exchange_sparse(side: int, first: np.ndarray, second: np.ndarray, number: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each word by exchange clustering: words move, one after the other, to the class that adds most to the
    class bigram likelihood, until no word moves or the sweeps are over. The last two rows (others, ends) keep classes
    of their own, numbered after the rest."""
    words = side - 2
    of = np.concatenate([np.arange(words) % classes, [classes, classes + 1]]).astype(np.int64)
    n = classes + 2
    hot_out = np.zeros((side, n))
    hot_in = np.zeros((side, n))
    np.add.at(hot_out, (first, of[second]), number)
    np.add.at(hot_in, (second, of[first]), number)
    own = np.zeros(side)
    own[first[first == second]] = number[first == second]
    by_first, by_second = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    to_first, to_second = np.searchsorted(first[by_first], np.arange(side + 1)), np.searchsorted(second[by_second], np.arange(side + 1))
    table = np.zeros((n, n))
    np.add.at(table, of, hot_out)
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    for _ in range(sweeps):
        moved = 0
        for w in range(words):
            old, self_ = of[w], own[w]
            o, i = hot_out[w].copy(), hot_in[w].copy()
            o[old] -= self_
            i[old] -= self_
            table[old] -= o
            table[:, old] -= i
            table[old, old] -= self_
            rows, cols = table.sum(1), table.sum(0)
            so, si = o.sum() + self_, i.sum() + self_
            c = np.arange(classes)
            gain = (f(table[c] + o) - f(table[c])).sum(1) + (f(table[:, c] + i[:, None]) - f(table[:, c])).sum(0)
            d = table[c, c]
            gain += f(d + o[c] + i[c] + self_) - f(d + o[c]) - f(d + i[c]) + f(d)
            gain -= f(rows[c] + so) - f(rows[c]) + f(cols[c] + si) - f(cols[c])
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = old
            table[new] += o
            table[:, new] += i
            table[new, new] += self_
            if new != old:
                of[w] = new
                moved += 1
                before, after = by_second[to_second[w] : to_second[w + 1]], by_first[to_first[w] : to_first[w + 1]]
                for t, x, g in ((hot_out, first[before], number[before]), (hot_in, second[after], number[after])):
                    t[x, old] -= g
                    t[x, new] += g
        if not moved:
            break
    return of


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per input row.

    Null text is empty and scores its end alone. A null doc_id is not held out. Equal doc_ids keep their rows. A token
    is unknown if no training text has it. Without training text nothing is known. An empty table gives an empty table;
    other columns are ignored.
    """
    m = train(docs, hot_words(docs))
    other, end = CLASSES, CLASSES + 1
    n = CLASSES + 2
    hot, cls, ends = m.words, m.cls, m.ends
    logs, known = np.log10(m.counts + ADD), (m.counts > 0).astype(np.int64)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row0 = TaskContext.get().partitionId() << 33
        for b in common.in_slices(batches):
            docs_, held = b.column("doc_id"), b.column("held_out")
            for first, run in blocks([t.encode() for t in common.texts_of(b.column("text"))]):
                words, upto = words_of_block(run)
                k = len(run)
                size = np.diff(upto, prepend=0)
                doc = np.repeat(np.arange(k), size)
                at = _lookup(hot, words)
                is_hot = at >= 0
                seq = np.where(is_hot, cls[at], other).astype(np.uint8) if len(hot) else np.full(len(words), other, dtype=np.uint8)
                take = lambda x: np.bincount(doc, weights=np.where(is_hot, x[at], 0), minlength=k) if len(hot) else np.zeros(k)  # noqa: E731, B023
                ids = row0 + np.arange(k)
                row0 += k
                cold = np.flatnonzero(~is_hot)
                cold = cold[np.lexsort((words[cold], doc[cold]))]
                w, d = words[cold], doc[cold]
                place_ = (cold - (upto - size)[d]).astype("<i4")
                i = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (d[1:] != d[:-1])])) if len(cold) else cold
                z = len(i)
                times = np.diff(np.append(i, len(cold))) if z else i
                part = lambda col: pa.concat_arrays([col.slice(first, k), pa.nulls(z, col.type)])  # noqa: E731, B023
                none = lambda x: pa.concat_arrays([x, pa.nulls(z, x.type)])  # noqa: E731, B023
                head = mix(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([ids, ids[d[i]]])), pa.array(np.concatenate([head, w[i]]).view(np.int64)), pa.concat_arrays([pa.nulls(k, pa.binary()), _binary(times * 4, place_.tobytes())]), pa.array(np.arange(k + z) < k),
                        part(docs_), part(held), none(_binary(size, seq.tobytes())), none(pa.array((take(known) + (ends > 0)).astype(np.int64))), none(pa.array(take(logs))),
                    ],
                    names=[x.split()[0] for x in TOKENS.split(", ")],
                )

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.in_slices(batches):
            seqs = b.column("seq").to_pylist()
            size = np.array([len(x) for x in seqs], dtype=np.int64)
            buf = np.frombuffer(b"".join(seqs), dtype=np.uint8).copy()
            of_list = np.repeat(np.arange(b.num_rows), b.column("cls").value_lengths().to_numpy(zero_copy_only=False))
            where = b.column("pos").flatten().to_pylist()
            times = np.array([len(x) // 4 for x in where], dtype=np.int64)
            at = np.frombuffer(b"".join(where), dtype="<i4") + np.repeat((np.cumsum(size) - size)[of_list], times)
            buf[at] = np.repeat(b.column("cls").flatten().to_numpy(zero_copy_only=False), times)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(size + 1), b.column("n_known"), b.column("logs"), _binary(size, buf.tobytes())], names=[x.split()[0] for x in SEQS.split(", ")])

    def chains(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class before, class, row) of all tokens and ends."""
        seqs = b.column("seq").to_pylist()
        size = np.array([len(x) for x in seqs], dtype=np.int64)
        now = np.insert(np.frombuffer(b"".join(seqs), dtype=np.uint8).astype(np.int64), np.cumsum(size), end)
        return np.concatenate([[end], now[:-1]]), now, np.repeat(np.arange(len(seqs)), size + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(n * n, dtype=np.int64)
        for b in common.in_slices(batches):
            if b.num_rows:
                before, now, _ = chains(b)
                pairs += np.bincount(before * n + now, minlength=n * n)
        p = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(pairs[p])], names=["k", "c"])

    spread = _rows(docs).mapInArrow(tokens, TOKENS).join(m.placed, "h", "left")
    word = ~F.col("head")
    count_ = F.coalesce("c", F.lit(0))
    times = F.length("pos") / 4
    whole = spread.groupBy("row").agg(
        F.max(F.when(F.col("head"), F.struct("doc_id", "held_out", "seq"))).alias("d"),
        F.sum(F.when(F.col("head"), F.col("n_known")).when(count_ > 0, times.cast("long")).otherwise(0)).alias("n_known"),
        F.sum(F.when(F.col("head"), F.col("logs")).otherwise(times * F.log10(count_ + ADD))).alias("logs"),
        F.collect_list(F.when(word, F.struct(F.coalesce("cls", F.lit(other)).alias("cls"), "pos"))).alias("cold"),
    )
    seqs = common.materialize(whole.select("d.*", "n_known", "logs", F.col("cold.cls").alias("cls"), F.col("cold.pos").alias("pos")).mapInArrow(fill, SEQS), "seqs")
    keys, c = _numbers(seqs.where("not held_out").select("seq").mapInArrow(count, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")), "k", "c")
    between = np.zeros((n, n))
    between.ravel()[keys] = c
    step = np.log10((between + ADD) / (between.sum(1, keepdims=True) + ADD * n))
    # Emission less the word's own count; a word without training text is the only one of its class.
    lean = np.log10(m.sizes + ADD * np.maximum(1, m.kinds))
    lean[end] = 0
    gain = step - lean[None, :]
    total = int(m.sizes[:other].sum()) + ends
    kinds = int(m.kinds[:other].sum()) + (ends > 0)
    base_all, end_base = float(np.log10(total + ADD * (kinds + 1))), float(np.log10(ends + ADD))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.in_slices(batches):
            before, now, row = chains(b)
            got, size = b.column("logs").to_numpy(), b.column("n_tokens").to_numpy()
            sums = got + np.bincount(row, weights=gain[before, now][: len(row)], minlength=b.num_rows) if b.num_rows else got
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("doc_id", "held_out", "n_tokens", "n_known")), pa.array(np.full(b.num_rows, total)), pa.array(got + end_base - size * base_all), pa.array(sums)], names=[x.split()[0] for x in SCORED.split(", ")])

    return seqs.mapInArrow(rate, SCORED)
