"""URL filters by link-graph propagation, in DataFrame operations only.

Rules judge the urls that they fit. For all others, hosts are judged: trust starts at hosts with allowed pages and flows
along links; distrust starts at hosts with blocked pages and flows against them (who links to a bad host is suspect).
Both are personalised PageRanks over host edges, with restarts at the seeds. Their masses shrink as a host gets more
links, so a host is judged by its suspicion instead: the blocked share of its pages or, if larger, of its links. It is
blocked where that reaches THRESHOLD and exceeds its trust as a part of a full seed's own mass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# The rules of the url filter.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DAMPING, ROUNDS, THRESHOLD = 0.85, 10, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule, of equal lengths the first by name; null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0]))[::-1]:
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path and the fitting rule of every row."""
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return parts.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("verdict"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts in the pages' html."""
    found = F.regexp_extract_all("html", F.lit(r"(?i)\bhref\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]+)"), F.lit(1))
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(found).alias("dst")).withColumn("dst", F.translate("dst", _UPPER, _LOWER))
    return links.where("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, mass) by personalised PageRank; seeds: host, seed; edges: a, b, n, mass flows from a to b in shares of n.

    Mass of hosts without outgoing edges isn't handed on. Each round is one join on the sending host and one
    pre-aggregated sum by the receiving host.
    """
    total = common.materialize(edges.groupBy("a").agg(F.sum("n").alias("total")), "totals")  # so that hubs split in the join
    share = common.materialize(edges.join(total, "a").select("a", "b", (F.col("n") / F.col("total")).alias("w")), "shares")
    start = seeds.select("host", (F.col("seed") * (1 - damping)).alias("mass"))
    now = start
    for k in range(rounds):
        flow = now.where("mass > 0").join(share, F.col("host") == F.col("a")).groupBy("b").agg((F.sum(F.col("mass") * F.col("w")) * damping).alias("mass"))
        now = start.unionByName(flow.withColumnRenamed("b", "host")).groupBy("host").agg(F.sum("mass").alias("mass"))
        if k % 5 == 4:
            now = common.materialize(now, f"mass{k}")
    return now


def suspicion(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, suspicion): the larger of the seed and of the average over the host's links and, as one more link, its seed.

    A link counts what its target hands on: its seed or, if larger, its own suspicion times damping. Each host divides by
    its own links only, so that neither the links into a blocked host nor the size of the graph change the figure.
    """
    total = common.materialize(edges.groupBy("src").agg(F.sum("n").alias("total")), "totals")  # so that hubs split in the join
    share = common.materialize(edges.join(total, "src").select("src", "dst", (F.col("n") / (1 + F.col("total"))).alias("w")), "links")
    start = seeds.join(total.withColumnRenamed("src", "host"), "host", "left").select("host", "seed", (F.col("seed") / (1 + F.coalesce("total", F.lit(0)))).alias("got"))
    start = common.materialize(start, "start")
    now = start
    for k in range(rounds):
        given = now.select("host", F.greatest("seed", F.col("got") * damping).alias("given")).where("given > 0")
        flow = share.join(given, F.col("dst") == F.col("host")).groupBy("src").agg(F.sum(F.col("given") * F.col("w")).alias("got"))
        now = start.unionByName(flow.select(F.col("src").alias("host"), F.lit(0.0).alias("seed"), "got")).groupBy("host").agg(F.max("seed").alias("seed"), F.sum("got").alias("got"))
        if k % 5 == 4:
            now = common.materialize(now, f"suspicion{k}")
    return now.select("host", F.greatest("seed", "got").alias("suspicion"))


def judge(pages: DataFrame, rules=RULES, damping: float = DAMPING, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust), one row per input row.

    Null urls, and urls without ://, have empty host and path; the empty host is no seed and is allowed. Null html has
    no links. Repeated rows stay and count as pages; an empty table gives an empty table; other columns are ignored.
    """
    rows = judged(pages, rules)
    share = lambda v: F.avg(F.when(F.col("verdict") == v, 1.0).otherwise(0.0))
    hosts = common.materialize(rows.where("host <> ''").groupBy("host").agg(share("allow").alias("allow"), share("block").alias("block")), "hosts")
    edges = common.materialize(host_edges(pages), "edges")
    scores = hosts.select("host", (F.col("allow") * (1 - damping)).alias("trust"), (F.col("block") * (1 - damping)).alias("distrust"), F.col("block").alias("suspicion"))
    if not edges.isEmpty():  # without links no mass moves
        # Hosts that are only linked to are seeds where a rule fits the whole host.
        named = edges.select(F.col("dst").alias("host")).distinct().join(hosts, "host", "left_anti").withColumn("v", rule_of(F.col("host"), F.lit("/"), rules)["verdict"])
        linked = named.where("v is not null").select("host", *(F.when(F.col("v") == v, 1.0).otherwise(0.0).alias(v) for v in ("allow", "block")))
        seeds = common.materialize(hosts.unionByName(linked), "seeds")
        along = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "n")
        trust = spread(seeds.select("host", F.col("allow").alias("seed")), along, damping, rounds).withColumnRenamed("mass", "trust")
        against = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "n")
        distrust = spread(seeds.select("host", F.col("block").alias("seed")), against, damping, rounds).withColumnRenamed("mass", "distrust")
        suspect = suspicion(seeds.select("host", F.col("block").alias("seed")), edges, damping, rounds)
        scores = hosts.select("host").join(trust, "host", "left").join(distrust, "host", "left").join(suspect, "host", "left").fillna(0.0, ["trust", "distrust", "suspicion"])
        scores = common.materialize(scores, "scores")  # so that a host of many pages splits in the join
    bad = (F.col("suspicion") >= threshold - 1e-9) & (F.col("suspicion") * (1 - damping) > F.col("trust"))
    out = rows.join(scores, "host", "left")
    verdict = F.coalesce("verdict", F.when(F.coalesce(bad, F.lit(False)), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
