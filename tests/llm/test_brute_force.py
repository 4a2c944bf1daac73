"""Operators against plain Python written apart from them: scores, digests, language and trees; odd tables."""

import collections
import json
import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.llm import bpe, brownlm, common, fingerprints, html, langid, neardup, packing, secrets, texthash

TEXTS = [(5, "one two three four"), (4, None), (3, ""), (2, "ab"), (2, "ab"), (1, "é日 one two three four five six"), (None, "no id"), (None, "no id too"), (7, "one two three five " * 4000)]


def plain_digest(raw):
    counts, most = [0] * 128, 0xFFFFFFFF
    for a, b, c in zip(raw, raw[1:], raw[2:], strict=False):
        h = (a * 0x9E3779B1 + b * 0x85EBCA6B + c * 0xC2B2AE35) & most
        counts[(((h ^ (h >> 15)) * 0x2C1B3C6D) & most) >> 25] += 1
    cuts = [sorted(counts)[k] for k in (31, 63, 95)]
    q = [sum(c > x for x in cuts) for c in counts]
    return min(255, round(8 * math.log2(len(raw) + 1))), q


def plain_hex(raw):
    size, q = plain_digest(raw)
    return bytes([size, *(q[i] + 4 * q[i + 1] + 16 * q[i + 2] + 64 * q[i + 3] for i in range(0, 128, 4))]).hex()


def plain_likeness(a, b):
    (m, p), (n, q) = plain_digest(a), plain_digest(b)
    return 1 - (sum((0, 1, 2, 6)[abs(x - y)] for x, y in zip(p, q, strict=True)) + min(24, abs(m - n))) / (128 * 6 + 24)


def test_fingerprints_and_likenesses(spark):
    got = sorted(map(str, (tuple(r) for r in fingerprints.compare_with_edits(spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(4)).select("doc_id", "fingerprint", "edited_fingerprint", F.round("near_edited", 9), F.round("near_next", 9)).collect())))
    rows = sorted(((i, t or "") for i, t in TEXTS), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    want = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(t) // 2
        new = (t[: len(t) - half] + after[:half]).encode()
        want.append((i, plain_hex(t.encode()), plain_hex(new), round(plain_likeness(t.encode(), new), 9), round(plain_likeness(t.encode(), after.encode()), 9)))
    assert got == sorted(map(str, want))


def test_class_scores(spark, monkeypatch):
    """The class model's score of every text, from its word classes and counts made here, also of words looked up by a join."""
    monkeypatch.setattr(brownlm, "CLUSTERED", 30)
    monkeypatch.setattr(brownlm, "GROWTH", 1)
    monkeypatch.setattr(brownlm.hot_words, "__defaults__", (brownlm.SAMPLE_ROWS, 20))
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(80)], k=rng.randint(0, 30)))) for i in range(120)] + [(500, None), (501, "never seen words w1")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    m = brownlm.train(df, brownlm.hot_words(df))
    cls = {int(h): int(c) for h, c in zip(m.words, m.cls, strict=True)} | {r["h"] % (1 << 64): r["cls"] for r in m.placed.collect()}
    split = {i: (t or "").split() for i, t in rows}
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    count = collections.Counter(w for i in train for w in split[i])
    number = lambda w: int(texthash.word_hashes(w.encode())[0][0])
    other, end, n = brownlm.CLASSES, brownlm.CLASSES + 1, brownlm.CLASSES + 2
    of = lambda w: cls[number(w)] if count[w] else other
    chain = {i: [end, *map(of, ws), end] for i, ws in split.items()}
    pairs = collections.Counter(p for i in train for p in zip(chain[i], chain[i][1:], strict=False))
    before = collections.Counter()
    for (a, _), c in pairs.items():
        before[a] += c
    size, kinds = collections.Counter(), collections.Counter()
    for w, c in count.items():
        size[of(w)] += c
        kinds[of(w)] += 1
    want = {}
    for i, ws in split.items():
        s = sum(math.log10((pairs[a, b] + 0.5) / (before[a] + 0.5 * n)) for a, b in zip(chain[i], chain[i][1:], strict=False))
        want[i] = s + sum(math.log10((count[w] + 0.5) / (size[of(w)] + 0.5 * max(1, kinds[of(w)]))) for w in ws)
    got = {r["doc_id"]: r["score"] for r in brownlm.score(df).collect()}
    assert got.keys() == want.keys() and np.allclose([got[i] for i in want], list(want.values()))


def test_language_scores(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    rows = [(1, "1234 --"), (2, None), (3, ""), (4, "a"), (6, "of"), (5, "ein langer Satz " * 60_000)] + [(100 + i, r["text"]) for i, r in enumerate(docs.limit(60).collect())]
    got = {r["doc_id"]: tuple(r)[1:] for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), model).collect()}
    for i, t in rows:
        if not any(c.isalpha() for c in t or ""):
            assert got[i] == ("und", 0.0, True)
            continue
        b, w = langid.features(t)
        z = (w.astype(float) @ model.table[b].astype(float) + model.bias) / model.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        assert got[i][0] == model.langs[int(p.argmax())] and math.isclose(got[i][1], p.max(), abs_tol=1e-5) and got[i][2] == (got[i][1] < model.threshold)


def test_language_of_a_text_does_not_depend_on_its_neighbours():
    rng = np.random.default_rng(0)
    m = langid.Model(["a", "b", "c"], rng.normal(size=(langid.BUCKETS, 3)).astype(np.float32), np.zeros(3, np.float32), 1.0, 0.2)
    texts = ["a", "", "bc", "the end", "x", "né", "12", "zz top"]
    _, together = langid.score(m, texts)
    assert np.allclose(together, [langid.score(m, [t])[1][0] for t in texts])
    assert np.allclose(together, langid.score(m, texts[::-1])[1][::-1])


def test_language_ties_and_no_model(spark):
    flat = langid.Model(["aa", "bb", "cc"], np.zeros((langid.BUCKETS, 3), np.float32), np.zeros(3, np.float32), 1.0, 0.2)
    df = spark.createDataFrame([(1, "some text"), (1, "some text"), (2, None)], "doc_id long, text string")
    assert sorted(r["lang_pred"] for r in langid.predict(df, flat).collect()) == ["aa", "aa", "und"]
    assert langid.accepted(df, None).count() == 3 and langid.accepted(df, flat).count() == 2
    assert langid.predict(df.where("doc_id > 5"), flat).count() == 0 and langid.fit(df.selectExpr("doc_id", "text", "cast(null as string) AS lang")) is None


# --- tree scoring --------------------------------------------------------------------------------------------------------


class Tree:
    def __init__(self, tag, up=None):
        self.tag, self.up, self.inside, self.points, self.order = tag, up, [], 0.0, 0


def grow(rng, up, depth):
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        if kind < 0.5 or depth > 4:
            p = Tree("p", up)
            p.inside = [(" ".join("word" + "," * (rng.random() < 0.2) for _ in range(rng.randint(1, 40))) + rng.choice(".x"), rng.random() < 0.25) for _ in range(rng.randint(1, 3))]
            up.inside.append(p)
        elif kind < 0.6:
            up.inside.append((" ".join(["loose"] * rng.randint(1, 30)), False))
        else:
            child = Tree(rng.choice(["div", "section", "nav", "div"]), up)
            grow(rng, child, depth + 1)
            up.inside.append(child)


def written(n):
    return "".join((f"<a href='/x'>{x[0]}</a>" if x[1] else x[0]) if isinstance(x, tuple) else f"<{x.tag}>{written(x)}</{x.tag}>" for x in n.inside)


def runs(n):
    """Children with neighbouring texts joined: (text, linked) or Tree."""
    out = []
    for x in n.inside:
        if isinstance(x, tuple) and out and isinstance(out[-1], tuple):
            out[-1] = (out[-1][0] + x[0], out[-1][1] + len(x[0]) * x[1])
        else:
            out.append((x[0], len(x[0]) * x[1]) if isinstance(x, tuple) else x)
    return out


def total(n, i):
    return sum((len(x[0]), x[1])[i] if isinstance(x, tuple) else 0 if x.tag == "nav" else total(x, i) for x in runs(n))


def density(n):
    return total(n, 1) / total(n, 0) if total(n, 0) else 0.0


def blocks_of(n):
    return [t for x in runs(n) for t in ([x[0]] if isinstance(x, tuple) else [] if x.tag == "nav" else blocks_of(x))]


def plain_extract(root):
    nodes = []

    def visit(n):
        nodes.append(n)
        for x in runs(n):
            if isinstance(x, tuple):
                points = (1 + x[0].count(",") + min(len(x[0]) // 100, 3)) * (1 - x[1] / len(x[0]))
                above = n.up if n.tag == "p" and n.up else n
                above.points += points
                if above.up:
                    above.up.points += points / 2
        for x in reversed(runs(n)):
            if isinstance(x, Tree) and x.tag != "nav":
                visit(x)

    visit(root)
    worth = lambda n: n.points * (1 - density(n))
    best = max(nodes, key=worth)
    if not total(best, 0):
        return ""
    if best.up is None:
        return "\n".join(blocks_of(best))

    def joins(x):
        if isinstance(x, tuple):
            return len(x[0]) > 80 and x[1] < len(x[0]) / 4
        if x.tag == "nav" or not total(x, 0):
            return False
        text = " ".join(blocks_of(x)) if x.tag == "p" else ""
        return worth(x) >= max(10.0, 0.2 * worth(best)) or bool(text) and (len(text) > 80 and density(x) < 0.25 or not total(x, 1) and text[-1] in ".!?")

    return "\n".join(t for x in runs(best.up) if x is best or joins(x) for t in ([x[0]] if isinstance(x, tuple) else blocks_of(x)))


def test_trees_score_like_plain_recursion():
    kept = 0
    for seed in range(400):
        root = Tree("body")
        grow(random.Random(seed), root, 0)
        page = f"<html><body>{written(root)}</body></html>"
        want = plain_extract(root)
        kept += bool(want) and len(want) < 0.8 * len(" ".join(blocks_of(root)))
        assert html.extract(page) == want, page
    assert kept > 20  # many pages lose something


# --- odd tables ----------------------------------------------------------------------------------------------------------


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert secrets.digests(secrets.scan(docs)).count() == 0 and secrets.redact(docs).columns == docs.columns and secrets.redact(docs).count() == 0
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert bpe.digests(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    assert neardup.deduplicate(docs).count() == 0 and langid.accepted(docs, langid.fit(docs)).count() == 0


def test_very_long_texts(spark):
    rng = random.Random(1)
    long = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(120_000)) + " "
    rows = [(1, long), (2, long + "password=abcdefghijklmnop"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["path"]: [(s["start"], s["end"]) for s in r["found"]] for r in secrets.scan(df).collect()}
    assert found == {1: [], 2: [(len(long), len(long) + 25)], 3: []}
    assert {r["doc_id"]: r["component_id"] for r in neardup.components(df).collect()} == {1: 1, 2: 1, 3: 3}
    got = {r["doc_id"]: r["near_next"] for r in fingerprints.compare_with_edits(df).collect()}
    assert got[2] > 0.9 > got[3]
    assert html.extract("<article><p>" + long + "</p></article>") == long.strip()


def test_redaction_beside_any_columns(spark):
    df = spark.createDataFrame([(1, "password=abcdefghijklmnop x", 1, 2, 3, 4, 5), (2, "clean", 6, 7, 8, 9, 10)], "doc_id long, text string, hits int, blob int, found int, clean int, _hits int")
    got = sorted(tuple(r) for r in secrets.redact(df).collect())
    assert got == [(1, "[secret] x", 1, 2, 3, 4, 5), (2, "clean", 6, 7, 8, 9, 10)]


def test_other_tokenizers_encode_whole_texts(tmp_path):
    path = P.path("word_bpe_49k.json")
    assert packing.encoder_of(path).by_words
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    t["normalizer"] = None
    other = tmp_path / "cased.json"
    other.write_text(json.dumps(t))
    enc = packing.encoder_of(str(other))
    assert not enc.by_words and enc.encode(["Ab  Cd", ""]) == [enc.plain("Ab  Cd"), b""]


def test_scratch_is_cleared_in_part(spark):
    first = common.materialize(spark.range(3), "a")
    mark = common.scratch_count()
    for name in ("b", "c", "d"):
        last = common.materialize(spark.range(4), name)
    assert common.clear_scratch(spark, since=mark, keep=1) == 2
    assert first.count() == 3 and last.count() == 4 and common.scratch_count() == mark + 1


def test_scratch_needs_a_shared_folder(monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(dict)

    with pytest.raises(RuntimeError):
        common.shared_dir(Session)
