"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import urls

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_filter(rules=urls.RULES, damping: float = urls.DAMPING, rounds: int = urls.ROUNDS, threshold: float = urls.THRESHOLD) -> str:
    """Rules, then the propagations with their rounds written out."""
    fit = " ".join(
        f"WHEN (host = '{r.split('/')[0]}' OR ends_with(host, '.{r.split('/')[0]}')) AND starts_with(path, '/{r.split('/', 1)[1]}') THEN '{r} {v}'" for r, v in sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    )
    seeds = ", ".join(f"CASE WHEN hit LIKE '% {v}' THEN 1.0 ELSE 0.0 END AS {v}" for v in ("allow", "block"))
    parts = [
        f"h AS (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UP}', '{_LOW}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)",
        f"j AS (SELECT *, CASE {fit} END AS hit FROM h)",
        "o AS (SELECT host, avg(CASE WHEN hit LIKE '% allow' THEN 1.0 ELSE 0.0 END) AS allow, avg(CASE WHEN hit LIKE '% block' THEN 1.0 ELSE 0.0 END) AS block FROM j WHERE host <> '' GROUP BY 1)",
        f"""l AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '(?i)\\bhref\\s*=\\s*["'']?\\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\\s>]+)', 1)), '{_UP}', '{_LOW}') AS dst FROM h WHERE host <> '')""",
        "e AS (SELECT src, dst, count(*) AS n FROM l WHERE src <> dst GROUP BY 1, 2)",
        f"g AS (SELECT host, CASE {fit} END AS hit FROM (SELECT DISTINCT dst AS host, '/' AS path FROM e) WHERE host NOT IN (SELECT host FROM o))",
        f"s AS (SELECT * FROM o UNION ALL SELECT host, {seeds} FROM g WHERE hit IS NOT NULL)",
        "ea AS (SELECT src AS a, dst AS b, n / sum(n) OVER (PARTITION BY src) AS w FROM e)",
        "eb AS (SELECT dst AS a, src AS b, n / sum(n) OVER (PARTITION BY dst) AS w FROM e)",
        "ec AS (SELECT src, dst, n / (1 + sum(n) OVER (PARTITION BY src)) AS w FROM e)",
        "c0 AS (SELECT host, block AS seed, block / (1 + coalesce((SELECT sum(n) FROM e WHERE src = host), 0)) AS got FROM s)",
    ]
    for kind, seed in (("a", "allow"), ("b", "block")):
        parts.append(f"{kind}0 AS (SELECT host, {seed} * {1 - damping} AS mass FROM s)")
        for k in range(rounds):
            parts.append(f"{kind}{k + 1} AS (SELECT host, sum(mass) AS mass FROM (SELECT * FROM {kind}0 UNION ALL SELECT b, sum(mass * w) * {damping} FROM {kind}{k} JOIN e{kind} ON host = a GROUP BY b) GROUP BY host)")
    for k in range(rounds):
        parts.append(f"c{k + 1} AS (SELECT host, max(seed) AS seed, sum(got) AS got FROM (SELECT * FROM c0 UNION ALL SELECT src, 0.0, sum(greatest(seed, got * {damping}) * w) FROM c{k} JOIN ec ON dst = host GROUP BY src) GROUP BY host)")
    bad = f"u >= {threshold} - 1e-9 AND u * {1 - damping} > t"
    return (
        "WITH "
        + ", ".join(parts)
        + f", m AS (SELECT j.*, coalesce(x.mass, 0) AS t, coalesce(y.mass, 0) AS d, coalesce(greatest(z.seed, z.got), 0) AS u FROM j LEFT JOIN a{rounds} x ON x.host = j.host LEFT JOIN b{rounds} y ON y.host = j.host LEFT JOIN c{rounds} z ON z.host = j.host)"
        + f" SELECT page_id, host, path, split_part(hit, ' ', 1) AS rule, CASE WHEN hit IS NOT NULL THEN split_part(hit, ' ', 2) WHEN {bad} THEN 'block' ELSE 'allow' END AS verdict, round(CAST(t AS DOUBLE), 9) AS trust, round(CAST(d AS DOUBLE), 9) AS distrust FROM m"
    )


_REACH = """, r AS (SELECT id, id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id), k AS (SELECT id, min(c) AS c FROM r GROUP BY 1)"""


def near_duplicates() -> str:
    """Shingle sets, all pairs that share one, exact similarity, reachability."""
    return f"""WITH RECURSIVE w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
n AS (SELECT id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) END AS sh FROM w),
u AS (SELECT id, len(sh) AS size, unnest(sh) AS x FROM n),
p AS (SELECT a.id AS a, b.id AS b, any_value(a.size) AS sa, any_value(b.size) AS sb, count(*) AS shared FROM u a JOIN u b ON a.x = b.x AND a.id <> b.id GROUP BY 1, 2),
e AS (SELECT a, b FROM p WHERE 100 * shared >= 75 * (sa + sb - shared)){_REACH}
SELECT id AS doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, c AS component_id, c = id AS kept FROM n JOIN k USING (id)"""


def vector_links() -> str:
    """All pairs of a label, exact cosine, reachability."""
    return f"""WITH RECURSIVE v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
g AS (SELECT id, label, x, sqrt(list_dot_product(x, x)) AS size FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND list_dot_product(x, x) > 0),
e AS (SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON a.label = b.label AND a.id <> b.id AND len(a.x) = len(b.x) WHERE list_dot_product(a.x, b.x) / (a.size * b.size) >= 0.98),
n AS (SELECT id FROM v){_REACH}
SELECT id AS vec_id, (SELECT count(*) FROM e WHERE e.a = id) AS n_links, c AS component_id, c = id AS kept FROM n JOIN k USING (id)"""


def oracle_sql() -> dict[str, str]:
    return {"op3_urls": url_filter(), "op5_near_dedup": near_duplicates(), "op6_vectors": vector_links()}
