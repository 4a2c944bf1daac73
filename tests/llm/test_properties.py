"""Properties of the pure parts, over generated inputs."""

import re

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe, fingerprints, html, neardup, packing, secrets, texthash, vectors

TEXT = st.text(alphabet=st.sampled_from(list("abcXYZ 019.,'\"=:/_-+\t\n\x0bé日�<>&;#")), max_size=120)
FEW = settings(max_examples=60, deadline=None)


@FEW
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=12))
def test_plan_uses_every_piece_once(counts):
    used: dict[int, int] = {}
    bins = packing.plan(dict(counts), 64)
    for b, times in bins:
        assert 0 < sum(n * m for n, m in b.items()) <= 64 and times > 0
        for n, m in b.items():
            used[n] = used.get(n, 0) + m * times
    assert used == counts
    table = packing.slots(bins)
    assert (np.diff(table["key"]) > 0).all()


@FEW
@given(st.lists(TEXT, max_size=8))
def test_words_and_shingles(texts):
    lower = {i: i + 32 for i in range(65, 91)}
    raw = [t.encode() for t in texts]
    want = [re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower)) for t in texts]
    hashes, upto = texthash.words_of_block(raw) if raw else (np.empty(0), np.empty(0, int))
    assert [int(x) for x in np.diff(upto, prepend=0)] == [len(w) for w in want]
    names: dict[int, str] = {}
    for h, w in zip(hashes.tolist(), [x for ws in want for x in ws], strict=True):
        assert names.setdefault(h, w) == w
    assert len(set(names.values())) == len(names)
    for s, w in zip(texthash.shingles_of_block(raw) if raw else [], want, strict=True):
        assert len(s) == (len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) if w else 0)


@FEW
@given(TEXT, st.integers(3, 30), st.integers(1, 12))
def test_chunks_encode_like_the_whole(text, chunk, overlap):
    codec = bpe.codec_of(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    ids = codec.encode(text, chunk, overlap)
    assert ids == codec.core.encode_ordinary(text) and codec.decode(ids) == text.encode()


@FEW
@given(st.lists(TEXT, max_size=5))
def test_word_cache_encodes_like_the_library(texts):
    enc = packing.encoder_of(P.path("word_bpe_49k.json"))
    assert enc.encode(texts) == [enc.plain(t) for t in texts]


@FEW
@given(TEXT)
def test_spans_are_ordered_and_triggered(text):
    for rule in secrets.RULES:
        spans = rule.spans(text)
        assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
        if spans:
            assert re.search(rule.trigger, text, re.A)


@FEW
@given(st.text(alphabet=st.sampled_from(list("<>/apdivulscript!-=\"' &;#x1")), max_size=150))
def test_extract_never_fails(page):
    out = html.extract(page)
    assert out == out.strip() and "  " not in out


@FEW
@given(st.binary(max_size=200), st.binary(max_size=200))
def test_likeness_is_bounded_and_symmetric(a, b):
    x, y = fingerprints.digest(a), fingerprints.digest(b)
    assert 0 <= fingerprints.likeness(x, y) == fingerprints.likeness(y, x) <= 1 == fingerprints.likeness(x, x)


@FEW
@given(st.sets(st.integers(0, 60), min_size=1), st.sets(st.integers(0, 60), min_size=1))
def test_similarity_is_exact(a, b):
    x, y = (np.array(sorted(s), dtype=np.uint64) for s in (a, b))
    got = neardup.Sets([x, y, x, y[:0]]).similar(0, np.array([1, 2, 3])).tolist()
    assert got == [1] * (100 * len(a & b) >= 75 * len(a | b)) + [2]


def test_bands_find_pairs_at_the_threshold():
    rng = np.random.default_rng(0)
    found = 0
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 125, dtype=np.uint64)
        one, two = np.sort(pool[:110]), np.sort(pool[15:])  # 95 of 125 shared: 0.76
        found += len(neardup.survivors(neardup.signature(one), neardup.signature(two)[None, :]))
    assert found == 300


def test_windows_hold_all_near_rows():
    rng = np.random.default_rng(1)
    x = vectors._unit(rng.normal(size=(700, 3)))
    group = np.repeat([0, 1, 1], [300, 200, 200])
    for window, begin in ((16, 0), (300, 5), (48, 299)):
        got = vectors.window_links(group, x, window, 0.98, begin)
        want = [(i, j) for i in range(700) for j in range(max(i + 1, begin), min(700, i + window + 1)) if group[i] == group[j] and x[i] @ x[j] >= 0.98]
        assert sorted(map(tuple, got.tolist())) == want
