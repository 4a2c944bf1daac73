"""Secret scans over an incremental blob ledger.

Every version of a text is addressed by its SHA-256. The ledger holds one row per (blob, rule version) that has been
scanned, with the spans found; a scan looks only at pairs that the ledger lacks and adds them, and findings are joined
back to every path that holds the blob, in any version. A rule's trigger, a plain pattern that each of its matches
contains, is tested while the blob is hashed, so that texts without triggers never move.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common


@dataclass(frozen=True)
class Rule:
    """pattern: Python, ASCII; least: code points that the group must have; trigger: the engine's own pattern."""

    kind: str
    version: int
    pattern: str
    trigger: str
    group: int = 0
    least: int = 0
    flags: int = field(default=re.ASCII)

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in re.compile(self.pattern, self.flags).finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


# The base rules, in the order of their kinds.
BASE = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"(?i)(?:passw(?:or)?d|secret|token|api_?key)[\"']? *[:=] *[\"']?[A-Za-z0-9+/_.=-]{12}", 2, 12, re.ASCII | re.IGNORECASE),
    Rule("access", 1, r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{14}", 0, 18),
    Rule("hex", 1, r"[0-9a-f]+", r"[0-9a-f]{16}", 0, 16),
)
# What the ledger's rule set adds to the base kinds.
ADDED = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ"),
)
RULES = BASE + ADDED
LEDGER = "blob string, rule string, spans array<struct<start:long,end:long>>"


def _hits(text: Column, rules: tuple[Rule, ...]) -> Column:
    return F.filter(F.array(*[F.when(text.rlike(r.trigger), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())


def update(docs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES, path: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(versions, new ledger rows). ledger: what earlier scans returned, or None before the first. Each text is hashed and
    tested for triggers once; only texts with a trigger are written beside their address."""
    marked = docs.select(F.col(path).alias("path"), F.coalesce("text", F.lit("")).alias("text")).withColumn("hits", _hits(F.col("text"), rules))
    address = F.sha2(F.col("text").cast("binary"), 256).alias("blob")
    seen = common.materialize(marked.select("path", address, "hits", F.when(F.size("hits") > 0, F.col("text")).alias("text")), "versions")
    return seen.select("path", "blob", "hits"), scan_unseen(seen, ledger, rules)


def scan_unseen(seen: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows of the pairs of blob and rule version that the ledger lacks; seen: blob, hits, text where hits are."""
    blobs = seen.groupBy("blob").agg(F.max("hits").alias("hits"))
    pairs = blobs.select("blob", F.explode(F.array(*[F.lit(r.name) for r in rules])).alias("rule"), "hits")
    if ledger is not None:
        pairs = pairs.join(ledger.select("blob", "rule").distinct(), ["blob", "rule"], "left_anti")
    pairs = pairs.select("blob", "rule", F.array_contains("hits", F.col("rule")).alias("hit"))
    pairs = common.materialize(pairs, "unseen") if ledger is not None else pairs
    none = F.from_json(F.lit("[]"), "array<struct<start:long,end:long>>")
    todo = pairs.where("hit").groupBy("blob").agg(F.collect_set("rule").alias("rules"))
    held = seen.where(F.size("hits") > 0).select("blob", "text").dropDuplicates(["blob"])
    by_name = {r.name: r for r in rules}

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(b, n, [{"start": s, "end": e} for s, e in by_name[n].spans(t)]) for b, t, names in zip(f["blob"], f["text"], f["rules"], strict=True) for n in names]
            yield pd.DataFrame(rows, columns=["blob", "rule", "spans"])

    found = todo.join(held, "blob").select("blob", "text", "rules").mapInPandas(scan, LEDGER)
    return common.materialize(pairs.where("not hit").select("blob", "rule", none.alias("spans")).unionByName(found), "ledger")


def findings(seen: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, blob, found): every version's spans under the current rule versions, by start and then order of kinds."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))])
    names = [r.name for r in rules]
    each = ledger.where(F.col("rule").isin(names) & (F.size("spans") > 0)).dropDuplicates(["blob", "rule"])
    each = each.select("blob", F.explode("spans").alias("s"), order[F.col("rule")].alias("ord"), F.split("rule", "@")[0].alias("kind"))
    by_blob = each.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("s.start", "ord", "s.end", "kind"))).alias("found"))
    by_blob = common.materialize(by_blob, "found")  # so that the join below has an exchange of its own and a hot blob splits
    return seen.select("path", "blob").join(by_blob, "blob", "left").select("path", "blob", F.coalesce("found", F.from_json(F.lit("[]"), "array<struct<start:long,ord:int,end:long,kind:string>>")).alias("found"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path: str = "doc_id") -> DataFrame:
    """(path, blob, found) of every row. Null text is empty and finds nothing; null or repeated paths keep their rows; an
    empty table gives an empty table; other columns are ignored."""
    seen, new = update(docs, ledger, rules, path)
    return findings(seen, new if ledger is None else ledger.select(new.columns).unionByName(new), rules)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """docs with every span of every rule replaced by mark and n_chars brought up to date; other columns, whatever their
    names, and rows without findings stay as they are. Null text stays null; an empty table gives an empty table."""
    names = docs.columns
    hits, blob, found, clean = (common.free_name(x, names) for x in ("hits", "blob", "found", "clean"))
    # Written with its hits, so that the triggers are tested once.
    marked = common.materialize(docs.withColumn(hits, _hits(F.coalesce("text", F.lit("")), rules)), "marked")
    hit = marked.where(F.size(hits) > 0).withColumn(blob, F.sha2(F.col("text").cast("binary"), 256))
    seen = hit.select(F.lit(0).alias("path"), F.col(blob).alias("blob"), F.col(hits).alias("hits"), "text")
    by_blob = findings(seen.select("path", "blob").distinct(), scan_unseen(seen, None, rules), rules)
    out = hit.drop(hits).join(by_blob.select(F.col("blob").alias(blob), F.col("found").alias(found)), blob, "left")

    def replace(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(**{clean: [_replaced(t, s, mark) for t, s in zip(f["text"], f[found], strict=True)]})

    out = out.mapInPandas(replace, T.StructType([*out.schema.fields, T.StructField(clean, T.StringType())])).withColumn("text", F.col(clean))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return marked.where(F.size(hits) == 0).select(*names).unionByName(out.select(*names))


def _replaced(text: str, spans, mark: str) -> str:
    out, at = [], 0
    for s in spans:
        if s["end"] > at:
            out += [text[at : max(at, s["start"])], mark]
            at = s["end"]
    return "".join([*out, text[at:]])


def digests(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and digest of the base kinds and all spans as text."""
    base = [r.kind for r in rules if r in BASE]

    def text(x: Column) -> Column:
        return F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    of = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(F.col("path").cast("long").alias("doc_id"), *map(of, base), F.sha2(text(F.filter("found", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))
