"""Bin edges, labels and bin expressions. Bins are right-closed unless said otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import nulls

INF = float("inf")


def edges_of(cutoffs: Sequence[float], include_inf: bool = True, decimals: int = 2) -> list[float]:
    cuts = sorted({round(float(c), decimals) for c in cutoffs})
    return [-INF, *cuts, INF] if include_inf else cuts


def labels_of(edges: Sequence[float], style: str = "simple", right: bool = True, decimals: int = 2) -> list[str]:
    """simple: <3, 3-6, >6; interval: (3, 6] or [3, 6)."""
    text = lambda v: "-inf" if v == -INF else "inf" if v == INF else f"{v:.{decimals}f}".rstrip("0").rstrip(".")
    out = []
    for a, b in zip(edges, edges[1:], strict=False):
        if style == "interval":
            out.append(f"({text(a)}, {text(b)}]" if right else f"[{text(a)}, {text(b)})")
        else:
            out.append(f"<{text(b)}" if a == -INF else f">{text(a)}" if b == INF else f"{text(a)}-{text(b)}")
    return out


def pick(c: Column | str, edges: Sequence[float], values: Sequence, right: bool = True, lowest: bool = False) -> Column:
    """values[i] where c lies in bin i; null outside and for null. lowest: the first edge belongs to the first bin."""
    c, out = nulls.col(c).cast("double"), None
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        low = F.lit(True) if a == -INF else (c > a if right else c >= a)
        high = F.lit(True) if b == INF else (c <= b if right else c < b)
        if lowest and right and i == 0 and a != -INF:
            low = c >= a
        inside = c.isNotNull() & low & high
        value = values[i] if isinstance(values[i], Column) else F.lit(values[i])
        out = F.when(inside, value) if out is None else out.when(inside, value)
    return out if out is not None else F.lit(None)


#: Up to so many rows the engine's own exact percentile is used, which holds all distinct values in one place.
FEW = 100_000
_ACCURACY = 100_000


def quantiles(df: DataFrame, column: str, probabilities: Sequence[float]) -> list[float]:
    """Exact linear quantiles of the present values; none without values.

    One pass gives the count and brackets, approximate quantiles a little under and over each probability. For large
    inputs a second one counts what lies below each bracket and a third ranks the few values inside.
    """
    x = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    slack = 3 / _ACCURACY + 3 / FEW  # both ranks around a probability lie inside, for any n over FEW
    wide = [min(1.0, max(0.0, p + s)) for p in probabilities for s in (-slack, slack)]
    cuts = x.agg(F.percentile_approx("x", F.array(*map(F.lit, wide)), _ACCURACY), F.min("x"), F.max("x"), F.count("x")).first()
    n = cuts[3]
    if not n:
        return []
    if n <= FEW:
        return list(x.agg(F.percentile("x", F.array(*map(F.lit, probabilities)))).first()[0])
    low = [cuts[1] if p <= slack else cuts[0][2 * i] for i, p in enumerate(probabilities)]
    high = [cuts[2] if p >= 1 - slack else cuts[0][2 * i + 1] for i, p in enumerate(probabilities)]
    below = x.agg(*[F.count(F.when(F.col("x") < F.lit(v), 1)).alias(f"b{i}") for i, v in enumerate(low)]).first()
    inside = F.array(*[F.when(F.col("x").between(a, b), F.lit(i)) for i, (a, b) in enumerate(zip(low, high, strict=True))])
    counts = x.select("x", F.explode(F.filter(inside, lambda v: v.isNotNull())).alias("i")).groupBy("i", "x").agg(F.count("*").alias("c"))
    running = Window.partitionBy("i").orderBy("x")
    start = F.get(F.array(*[F.lit(v) for v in below]), F.col("i"))
    ranked = counts.withColumn("upto", start + F.sum("c").over(running)).withColumn("from", F.col("upto") - F.col("c"))
    place = F.get(F.array(*[F.lit(p * (n - 1)) for p in probabilities]), F.col("i"))
    wanted = ranked.where(((F.col("from") <= F.floor(place)) & (F.floor(place) < F.col("upto"))) | ((F.col("from") <= F.ceil(place)) & (F.ceil(place) < F.col("upto"))))
    ends = {r["i"]: (r["a"], r["b"]) for r in wanted.groupBy("i").agg(F.min("x").alias("a"), F.max("x").alias("b")).collect()}  # two values a probability
    out = []
    for i, p in enumerate(probabilities):
        a, b = ends[i]
        out.append(a + (b - a) * (p * (n - 1) - int(p * (n - 1))))
    return out


def quantile_edges(df: DataFrame, column: str, n: int) -> list[float]:
    """Distinct exact linear quantiles at 0, 1/n, ..., 1."""
    return sorted(set(quantiles(df, column, [i / n for i in range(n + 1)])))


def bin_column(df: DataFrame, column: str, strategy="step", n_bins: int = 10, step: float = 1.0, edges: Sequence[float] | None = None) -> Column:
    """The bin's value: the nearest step (halves to even), the value itself, or the right edge of a quantile or custom bin."""
    if strategy == "discrete":
        return F.col(column).cast("double")
    if strategy == "step":
        return nulls.round_step(column, step)
    cuts = list(edges) if edges is not None else quantile_edges(df, column, n_bins)
    if len(cuts) == 1:
        return F.when(F.col(column).isNotNull(), F.lit(cuts[0]))
    return pick(column, cuts, [float(b) for b in cuts[1:]], lowest=edges is None)


def centers(edges: Sequence[float], side: str = "mid") -> list[float]:
    """Mid, left or right of each bin; where that is infinite, its finite edge."""
    out = []
    for a, b in zip(edges, edges[1:], strict=False):
        v = {"mid": (a + b) / 2, "left": a, "right": b}[side]
        out.append(v if abs(v) != INF and v == v else b if a == -INF and b != INF else a if a != -INF else 0.0)
    return out
