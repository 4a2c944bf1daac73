"""Near-duplicates, vectors, URL filters, HTML extraction, components and the pipeline against brute force."""

import collections
import random
import re

import numpy as np
import pytest

from tests.conftest import SF
from tidemark.llm import common, html, neardup, queries, urls, vectors


def reach(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_random(spark):
    rng = random.Random(4)
    for size, n in ((60, 40), (80, 200), (30, 0)):
        links = [(rng.randrange(size), rng.randrange(size)) for _ in range(n)] + [(i, i + 1) for i in range(100, 130) if n]
        df = spark.createDataFrame([*links, (5, None)], "a long, b long")
        got = {r["node"]: r["component"] for r in common.connected_components(df).collect()}
        want = reach({x for ab in links for x in ab}, links)
        assert got == {k: v for k, v in want.items() if any(k in ab and ab[0] != ab[1] for ab in links)}


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(a, b):
    return bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)


def texts(rng, n, base=80):
    say = lambda k: ["".join(rng.choices("abcdefgh", k=4)) for _ in range(k)]
    out = [(i, " ".join(say(rng.randint(1, 60)))) for i in range(n)]
    seed = say(base)
    for i in range(n, 3 * n):
        w = list(seed)
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 6))):
            w[rng.randrange(base)] = "".join(rng.choices("xyz", k=5))
        out.append((i, " ".join(w)))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("block", [neardup.BLOCK, 12])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "WHOLE", min(neardup.WHOLE, block))
    rows = texts(random.Random(9), 60)
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "ONE two"), (1005, "one two three")]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, component_id int").repartition(5)
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if near(sets[a], sets[b])]
    want = reach(ids, links)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.components(df).collect()}
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in ids}
    kept = neardup.deduplicate(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i in ids if want[i] == i}


def test_near_duplicates_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "q w e r t y"), (2, "Q W E R T Y"), (None, "a b c d e f"), (3, "a b c d e f")]
    got = collections.Counter(tuple(r) for r in neardup.components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == collections.Counter([(1, 2, 1, True)] * 3 + [(2, 2, 1, False), (3, 2, 1, False), (None, 2, None, True)])
    assert neardup.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_posterior_bounds_rise():
    m = neardup.least_matches()
    assert len(m) == neardup.HASHES // neardup.BATCH and list(m) == sorted(m) and m[0] > 0
    assert all(x < 0.75 * (i + 1) * neardup.BATCH for i, x in enumerate(m))


def brute_vectors(rows):
    good = {}
    for i, e, label in rows:
        if i is None or label is None or e is None or not len(e) or any(v is None or not np.isfinite(v) for v in e) or not any(e):
            continue
        good[i] = (np.asarray(e, float) / np.linalg.norm(np.asarray(e, float)), label)
    links = [(a, b) for a in good for b in good if a < b and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] >= 0.98]
    n = collections.Counter(x for ab in links for x in ab)
    ids = {r[0] for r in rows if r[0] is not None}
    return n, reach(ids, links)


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(30):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 8)):
            rows.append((len(rows), (base + rng.normal(scale=0.02, size=16)).tolist(), int(c % 3)))
    one = rng.normal(size=16)
    rows += [(len(rows) + i, (one + rng.normal(scale=1e-3, size=16)).tolist(), 1) for i in range(150)]
    rows += [(len(rows) + i, rows[0][1], 0) for i in range(5)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, rows[0][1], None), (n + 4, [], 1), (n + 5, [None] + [1.0] * 15, 0), (n + 6, [1.0, 0.0], 1), (n + 7, [2.0, 0.0], 1), (n + 8, [1e200] * 16, 2), (n + 9, [float("inf")] + [0.0] * 15, 2)]
    links, comp = brute_vectors(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, rep int").repartition(4)
    for whole, window in ((vectors.WHOLE, vectors.WINDOW), (16, 8)):
        monkeypatch.setattr(vectors, "WHOLE", whole)
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(df, window=window).collect()}
        assert got == {i: (links[i], comp[i], comp[i] == i) for i in comp}
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


@pytest.mark.parametrize("partitions,batch", [(1, 10_000), (4, 64), (64, 64), (200, 10_000)])
def test_vector_links_do_not_depend_on_layout(spark, partitions, batch):
    """One group of 1,500 near copies, of which all are linked, and some rows apart."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(scale=0.01, size=16)).tolist(), 1) for i in range(1500)] + [(2000 + i, rng.normal(size=16).tolist(), 1) for i in range(20)]
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(keep, (partitions, batch, "false"), strict=True):
            spark.conf.set(k, v)
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    links, comp = brute_vectors(rows)
    assert got == {i: (links[i], comp[i]) for i in comp} and sum(links.values()) == 1500 * 1499


def test_windows_reach_over_small_ranges():
    met = vectors._meetings([(0, 100), (3, 2), (4, 1), (9, 50)], 48)
    assert [m for m in met if m[2] == 3] == [(9, "head", 3), (4, "tail", 3), (3, "tail", 3), (0, "tail", 3)]
    assert [m for m in met if m[2] == 1] == [(3, "head", 1), (0, "tail", 1)]


def test_vectors_of_a_shared_id(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.001], 0), (3, [0.001, 1.0], 0), (4, [1.0, 1.0], 0), (2, [1.0, 0.001], 0), (None, [1.0, 0.0], 0)]
    got = sorted(map(str, (tuple(r) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())))
    assert got == sorted(map(str, [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True), (None, 0, None, True)]))


def test_vectors_of_single_precision(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(20, 12))
    x = np.concatenate([base, base + rng.normal(scale=0.03, size=base.shape), base + rng.normal(scale=0.05, size=base.shape)]).astype(np.float32)
    rows = [(i, [float(v) for v in e], i % 2) for i, e in enumerate(x)]
    links, comp = brute_vectors(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df).collect()} == {i: (links[i], comp[i]) for i in comp}


PAGES = [
    (1, "http://A.Example.NET/en/x?q#f", '<a href="http://bad.example.com/de/1">x</a> <a href=\'//c.org/\'>'), (2, "http://bad.example.com/de/2", '<a href="https://bad.example.com/x">'), (3, "http://bad.example.com/en/", None),
    (4, "https://c.org", '<a HREF=http://D.org/fr/>'), (5, "https://d.org/fr/a", ""), (6, "https://friend.org/x", '<a href="http://bad.example.com/1"><a href="http://bad.example.com/2">'), (7, None, None), (8, "nothing", "<a href='http://d.org'>"), (9, "net", ""), (10, "x://net/", ""), (10, "x://net", ""), (11, "http://d.org/en", ""),
    (12, "http://deep.org/", '<a href="http://friend.org/">'),
]


def rule(host, path):
    fits = [(r, v) for r, v in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=lambda x: len(x[0])) if fits else None


def brute_urls(rows):
    out, share, edges = [], collections.defaultdict(list), collections.Counter()
    for i, u, h in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        r = rule(host, path)
        out.append((i, host, path, r))
        if host:
            share[host].append(r[1] if r else None)
        for d in re.findall(r"(?i)\bhref\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]+)", h or ""):
            if host and d.lower() != host:
                edges[(host, d.lower())] += 1
    mass, linked = {}, {}
    for kind, flip in (("allow", False), ("block", True)):
        linked[kind] = {b: 1.0 for _, b in edges if b not in share and (rule(b, "/") or (0, 0))[1] == kind}
        seed = {h: sum(x == kind for x in v) / len(v) for h, v in share.items()} | linked[kind]
        e = {((b, a) if flip else (a, b)): n for (a, b), n in edges.items()}
        total = collections.Counter()
        for (a, _), n in e.items():
            total[a] += n
        now = {h: 0.15 * s for h, s in seed.items()}
        for _ in range(urls.ROUNDS):
            new = collections.Counter({h: 0.15 * s for h, s in seed.items()})
            for (a, b), n in e.items():
                new[b] += 0.85 * now.get(a, 0) * n / total[a]
            now = new
        mass[kind] = now
    seed = {h: sum(x == "block" for x in v) / len(v) for h, v in share.items()} | linked["block"]
    links = collections.Counter()
    for (a, _), n in edges.items():
        links[a] += n
    got = own = {h: s / (1 + links[h]) for h, s in seed.items()}
    for _ in range(urls.ROUNDS):
        last, got = got, collections.Counter(own)
        for (a, b), n in edges.items():
            got[a] += max(seed.get(b, 0), 0.85 * last.get(b, 0)) * n / (1 + links[a])
    rows = []
    for i, host, path, r in out:
        t, d = mass["allow"].get(host, 0), mass["block"].get(host, 0)
        t, d = (t, d) if host else (0, 0)
        u = max(seed.get(host, 0), got.get(host, 0)) if host else 0
        rows.append((i, host, path, r[0] if r else None, r[1] if r else "block" if u >= 0.5 - 1e-9 and u * 0.15 > t else "allow", round(t, 9), round(d, 9)))
    return sorted(map(str, rows))


def test_url_verdicts(spark):
    df = spark.createDataFrame([(*r, "x") for r in PAGES], "page_id long, url string, html string, host string").repartition(3)
    got = urls.judge(df).collect()
    assert sorted(str((*tuple(r)[:5], round(r[5], 9) + 0, round(r[6], 9) + 0)).replace("0.0,", "0,").replace("0.0)", "0)") for r in got) == sorted(x.replace("0.0,", "0,").replace("0.0)", "0)") for x in brute_urls(PAGES))
    v = {r["page_id"]: r["verdict"] for r in got}
    assert v[3] == "block" and v[6] == "allow" and v[7] == "allow" and v[1] == "allow"
    alone = [(1, "http://sad.example.com/de/", None), (2, "http://fan.org/x", "<a href='http://sad.example.com/'>")]
    assert {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(alone, "page_id long, url string, html string")).collect()} == {1: "block", 2: "block"}
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.judge(empty).count() == 0


def test_url_sql_with_links(spark):
    """The registered SQL on pages with links, which the supplied tables lack."""
    import duckdb

    rng = random.Random(8)
    hosts = [f"h{i}.{t}" for i in range(12) for t in ("org", "net", "com")] + ["bad.example.com", "sad.example.com", "a.example.net"]
    rows = [(i, f"http://{rng.choice(hosts[:-1])}/{rng.choice(('de/x', 'en/y', 'fr/z', ''))}", "".join(f"<a href='http://{rng.choice(hosts)}/x'>" for _ in range(rng.randint(0, 6)))) for i in range(120)]
    for pages in (rows, PAGES):
        con = duckdb.connect()
        con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
        con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
        want = con.execute(queries.oracle_sql()["op3_urls"]).fetchall()
        got = urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string"))
        mine, theirs = (sorted((tuple(r) for r in x), key=lambda r: (str(r[:5]), r[5], r[6])) for x in (got.collect(), want))
        assert [r[:5] for r in mine] == [r[:5] for r in theirs] and np.allclose([r[5:] for r in mine], [r[5:] for r in theirs], atol=1e-8)
        verdicts = collections.Counter((r[3] is None, r[4]) for r in want)
        assert verdicts[True, "block"] and verdicts[True, "allow"]


def test_url_plan_is_native(spark):
    plan = urls.judge(spark.createDataFrame(PAGES, "page_id long, url string, html string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


BODY = "".join(f"<p>Paragraph {i}, with some words, commas and a <a href='/x'>link</a> &amp; more text &eacute; to read.</p>" for i in range(6))
WANT = [f"Paragraph {i}, with some words, commas and a link & more text é to read." for i in range(6)]


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""), ("", ""), ("   ", ""), ("plain only", "plain only"),
        (f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li><a href=/a>a</a></li></ul></nav><article><h1>Head</h1>{BODY}</article><footer>foot</footer></body></html>", "\n".join(["Head", *WANT])),
        (f"<body><div id='header-menu' class='menu'>Menu, menu, menu</div><div class='content'><div class='post'>{BODY}</div><div class='comments'><p>Great, nice, lovely comment, indeed, yes.</p></div></div><div class=sidebar><p>Side, bar, text, many, commas, here, for, you.</p></div></body>", "\n".join(WANT)),
        (f"<main><script>var t='</p>';</script><div class='cookie-notice'>We use cookies, ok, fine.</div>{BODY}<form><p>Sign up, now, please.</p></form><!-- c --></main>", "\n".join(WANT)),
        ("<article><p><b>One sentence here.<br><p>Two\n  spaces\tand &lt;tags&gt; &#233;&#x41;.</p></article>", "One sentence here.\nTwo spaces and <tags> éA."),
        (f"<body><div class='ad'>Buy, buy, buy, buy, buy, buy, buy</div><section><h2>T</h2>{BODY}<ul><li>item one</li><li>item two</li></ul></section><aside>{BODY}</aside></body>", "\n".join(["T", *WANT, "item one", "item two"])),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<p>unclosed <b>bold <p>next <script>x", "unclosed bold\nnext"),
    ],
)
def test_extract(page, want):
    assert html.extract(page or "") == want


def test_extract_deep_and_broken():
    deep = "<div>" * 3000 + "<p>Deep text, really.</p>" + "</div>" * 3000
    assert html.extract(deep) == "Deep text, really."
    for junk in ("<", "<<<<a", "<p", "<!--", "<script>", "</p></p>", "&#xFFFFFFFF; &#0;", "<a href='x", "<p class='ad>x</p>'>"):
        html.extract(junk)


def test_extract_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>A, b.</p>", "t"), (None, None, None, "t"), (1, "u", "<p>A, b.</p>", "t")], "page_id long, url string, html string, text string")
    got = sorted(map(str, [tuple(r) for r in html.main_text(df).collect()]))
    assert got == sorted(map(str, [(1, "u", "A, b.", 5), (1, "u", "A, b.", 5), (None, None, "", 0)]))
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in html.main_text(pages).collect():
        assert r["text"] and "track(" not in r["text"] and "©" not in r["text"] and r["n_chars"] == len(r["text"])


def test_pipeline(spark):
    import corpus_pipeline
    from tidemark.llm import secrets

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now, counts = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = common.materialize(stage(spark, now, SF), name)
        assert now.columns == docs.columns
        counts.append(now.count())
    assert docs.count() >= counts[0] >= 0.95 * docs.count() and counts[1] == counts[2] < counts[0]
    sets = [shingles(r["text"]) for r in now.collect()]
    assert sum(near(a, b) for i, a in enumerate(sets) for b in sets[:i]) <= 1  # redaction may bring two texts together
    assert secrets.scan(now).where("size(found) > 0").count() == 0
    out = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == {r["doc_id"] for r in now.select("doc_id").collect()}
    assert out.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_scratch_tables_can_be_cleared(spark):
    df = common.materialize(spark.range(3), "x")
    assert df.count() == 3 and common.shared_dir(spark) in df.inputFiles()[0]
    assert common.clear_scratch(spark) >= 1 and common.clear_scratch(spark) == 0


@pytest.mark.parametrize("linkers", [2, 20, 2000])
def test_url_verdict_does_not_depend_on_in_links(spark, linkers):
    rows = [(0, "http://bad.example.com/de/", None)]
    rows += [(i, f"http://fan{i}.org/", "<a href='http://bad.example.com/x'>") for i in range(1, linkers + 1)]
    rows += [(10_000 + i, f"http://far{i}.org/", "<a href='http://unseen.net/x'>") for i in range(linkers)]
    rows += [(20_000, "http://fair.org/", "<a href='http://bad.example.com/'>" + "<a href='http://good.com/'>" * 9)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {(r["verdict"], r["page_id"] == 20_000) for r in got.collect()} == {("block", False), ("allow", True)}


@pytest.mark.parametrize("open_", ["<ul>" + "<li>item" * 1000 + "</ul>", "<table>" + "<tr><td>a<td>b<td>c" * 300 + "</table>", "<div>" * 1000 + "</div>" * 1000])
def test_extract_after_many_open_and_implied_ends(open_):
    got = html.extract(f"<article>{BODY}{open_}<nav>menu, menu</nav><p>Last one, here.</p><p>Very last, here.</p></article>")
    assert got.startswith("\n".join(WANT)) and got.endswith("\nLast one, here.\nVery last, here.") and "menu" not in got
    assert html.extract("<div>" * 2000 + "<nav>menu, menu</nav><p>One, here.</p><p>Two, here.</p>") == "One, here.\nTwo, here."


def test_components_in_rounds(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(common, "CONTRACTED", 0)  # every graph takes the rounds between tasks
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 3000 + i) for i in range(200)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    want = reach({x for ab in links for x in ab}, links)
    assert got == {k: v for k, v in want.items() if any(k in ab and ab[0] != ab[1] for ab in links)}


def test_contraction_of_random_graphs():
    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (5, 3), (50, 40), (400, 390), (400, 900)):
        u, v = rng.integers(0, n, m), rng.integers(0, n, m)
        want = reach({*u.tolist(), *v.tolist()}, list(zip(u.tolist(), v.tolist(), strict=True)))
        assert dict(zip(*(x.tolist() for x in common.smallest_reachable(u, v)), strict=True)) == want


def test_near_duplicates_of_a_template_and_long_texts(spark, monkeypatch):
    """Texts that share bands but not enough shingles, with a few true pairs, dealt into many chunks by size."""
    monkeypatch.setattr(neardup, "CHUNK_SHINGLES", 400)
    rng = random.Random(12)
    say = lambda k: ["".join(rng.choices("abcdefgh", k=5)) for _ in range(k)]
    shell, rows = say(40), []
    for i in range(60):
        own = say(9)
        rows += [(2 * i, " ".join(shell + own)), (2 * i + 1, " ".join(shell + own[:-1]))]
    rows.append((500, " ".join(say(3000))))
    rows.append((501, rows[-1][1] + " end"))
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    want = reach(ids, [(a, b) for i, a in enumerate(ids) for b in ids[:i] if near(sets[a], sets[b])])
    got = {r["doc_id"]: r["component_id"] for r in neardup.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert got == want


def test_deduplicate_beside_odd_column_names(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 1, 2), (2, "a b c d e f", 3, 4), (3, "z", 5, 6)], "doc_id long, text string, __gone int, kept int")
    assert sorted(tuple(r) for r in neardup.deduplicate(df).collect()) == [(1, "a b c d e f", 1, 2), (3, "z", 5, 6)]


def test_prefilter_keeps_all_partners(spark, monkeypatch):
    df = spark.range(5000).selectExpr("id", "id * 2 AS t")
    keys = common.materialize(spark.range(0, 5000, 7), "keys")
    for most in (common.MOST_BITS, 64):
        monkeypatch.setattr(common, "MOST_BITS", most)
        got = {r["id"] for r in common.likely_in(df, "id", keys).collect()}
        assert got >= set(range(0, 5000, 7)) and (len(got) < 800 or most == 64)
    assert common.likely_in(df, "id", keys.where("id < 0")).count() == 0
