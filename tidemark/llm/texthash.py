"""Words, shingles and their 64-bit hashes, vectorised over blocks of whole texts.

A word is a run of bytes other than space and 0x09-0x0D after A-Z are lower-cased; UTF-8 continuation bytes never look
like separators, so bytes and code points give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_GAP = np.zeros(256, dtype=bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 20
#: Bytes of a block whose arrays (some 40 bytes for each of its bytes in language scores) should stay small beside an executor's heap.
SMALL = 1 << 17
_POWERS: dict[str, np.ndarray] = {}
SHINGLE = 5
_TURNS = np.array([0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser in which every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, min(_BLOCK + 1, 1 << int(n).bit_length()))
        for name, base in (("up", _BASE), ("down", _UNBASE)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gap = np.empty(len(buf) + 2, dtype=bool)
    gap[0] = gap[-1] = True
    gap[1:-1] = _GAP[buf]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[0::2], edge[1::2]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word of raw, which is lower-cased already. Works in blocks cut at words."""
    buf = np.frombuffer(raw, dtype=np.uint8)
    starts, ends = word_spans(buf)
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + _BLOCK, side="right")))
        hi = int(ends[j - 1])
        up, down = _powers(hi - lo + 1)
        run = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum((buf[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=run[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((run[e] - run[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out, starts


def blocks(texts: list[bytes], size: int = _BLOCK) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) in runs of about size bytes."""
    first, run, total = 0, [], 0
    for i, t in enumerate(texts):
        run.append(t)
        total += len(t) + 1
        if total >= size:
            yield first, run
            first, run, total = i + 1, [], 0
    if run:
        yield first, run


def words_of_block(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, number of words up to each text's end) of texts that are not yet lower-cased."""
    hashes, starts = word_hashes(b" ".join(run).translate(LOWER))
    ends = np.cumsum([len(t) + 1 for t in run])
    return hashes, np.searchsorted(starts, ends)


def shingles_of_block(run: list[bytes]) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; a text of fewer than five words has one, without words none."""
    words, upto = words_of_block(run)
    n = len(words)
    if n >= SHINGLE:
        s = np.zeros(n - SHINGLE + 1, dtype=np.uint64)
        for k in range(SHINGLE):
            s += words[k : n - SHINGLE + 1 + k] * _TURNS[k]
        s = mix(s)
    out, lo = [], 0
    for hi in upto.tolist():
        m = hi - lo
        if m >= SHINGLE:
            own = np.sort(s[lo : hi - SHINGLE + 1])
            out.append(own[np.r_[True, own[1:] != own[:-1]]])
        elif m:
            out.append(mix(np.array([(words[lo:hi] * _TURNS[:m]).sum(dtype=np.uint64) + np.uint64(m)], dtype=np.uint64)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
        lo = hi
    return out
