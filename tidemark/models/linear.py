"""Least squares on distributed sums: one pass for the normal equations, a small solve on the driver."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def gram(df: DataFrame, columns: Sequence[Column], weight: Column | None = None) -> tuple[np.ndarray, int]:
    """(sums of weighted products of all pairs of columns, rows) over rows with all present. p (p + 1) / 2 numbers."""
    p = len(columns)
    w = F.lit(1.0) if weight is None else weight.cast("double")
    named = df.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)], w.alias("w")).dropna()
    if p > WIDE:
        return _gram_by_batches(named, p)
    sums = [F.sum(F.col("w") * F.col(f"c{i}") * F.col(f"c{j}")).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p)]
    row = named.agg(F.count("*").alias("n"), *sums).first()
    out = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            out[i, j] = out[j, i] = row[f"s{i}_{j}"] or 0.0
    return out, row["n"]


#: From so many columns on, each task multiplies matrices instead of the engine keeping p (p + 1) / 2 sums as one row.
WIDE = 24


def _gram_by_batches(named: DataFrame, p: int) -> tuple[np.ndarray, int]:
    import pyarrow as pa

    def rows(batches):
        total, n = np.zeros((p, p)), 0
        for b in batches:
            x = np.column_stack([b.column(f"c{i}").to_numpy(zero_copy_only=False) for i in range(p)])
            total += (x * b.column("w").to_numpy(zero_copy_only=False)[:, None]).T @ x
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(p * p + 1)), pa.array(np.append(total.ravel(), n))], names=["k", "s"])

    got = {r["k"]: r["s"] for r in named.mapInArrow(rows, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()}
    return np.array([got.get(k, 0.0) for k in range(p * p)]).reshape(p, p), int(got.get(p * p, 0))


def grams(df: DataFrame, by: str, columns: Sequence[Column], weight: Column | None = None) -> dict:
    """gram of each level of a category column that isn't null, in one grouped aggregate: {level: (sums, rows)}."""
    p = len(columns)
    w = F.lit(1.0) if weight is None else weight.cast("double")
    named = df.select(F.col(by).alias("level"), *[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)], w.alias("w")).dropna()
    sums = [F.sum(F.col("w") * F.col(f"c{i}") * F.col(f"c{j}")).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p)]
    out = {}
    for r in named.groupBy("level").agg(F.count("*").alias("n"), *sums).collect():  # one row a category
        g = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)], dtype=float)
        out[r["level"]] = (g, r["n"])
    return out


@dataclass
class Line:
    """A fitted linear model."""

    features: list[str]
    coefficients: np.ndarray
    intercept: float
    r2: float
    rows: int
    errors: np.ndarray | None = None

    def column(self) -> Column:
        out = F.lit(self.intercept)
        for f, c in zip(self.features, self.coefficients, strict=True):
            out = out + F.col(f) * F.lit(float(c))
        return out


def solve(xtx: np.ndarray, xty: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    m = xtx + ridge * np.eye(len(xtx))
    try:
        return np.linalg.solve(m, xty)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(m, xty, rcond=None)[0]


def least_squares(df: DataFrame, y: str, xs: Sequence[str], weight: str | None = None, ridge: float = 0.0, constant: bool = True) -> Line:
    """Ordinary or weighted least squares, with a constant unless told otherwise; standard errors for ridge 0."""
    cols = [F.lit(1.0)] * constant + [F.col(x) for x in xs] + [F.col(y)]
    g, n = gram(df, cols, F.col(weight) if weight else None)
    p = len(cols) - 1
    b = solve(g[:p, :p], g[:p, p], ridge)
    rss = g[p, p] - 2 * b @ g[:p, p] + b @ g[:p, :p] @ b
    tss = g[p, p] - g[0, p] ** 2 / g[0, 0] if constant else g[p, p]
    errors = np.sqrt(np.maximum(0, np.diag(np.linalg.pinv(g[:p, :p])) * rss / max(1, n - p)))
    return Line(list(xs), b[1:] if constant else b, float(b[0]) if constant else 0.0, float(1 - rss / tss) if tss else 0.0, n, errors)


def group_lines(df: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    """One-factor least squares of every group, in one aggregate."""
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def constrained(df: DataFrame, y: str, xs: Sequence[str], bounds: dict[str, tuple[float | None, float | None]], constant: bool = True, sweeps: int = 2000) -> Line:
    """Least squares with a range per coefficient, by coordinate descent on the sums."""
    cols = [F.lit(1.0)] * constant + [F.col(x) for x in xs] + [F.col(y)]
    g, n = gram(df, cols)
    p = len(cols) - 1
    a, c = g[:p, :p], g[:p, p]
    limits = [(-np.inf, np.inf)] * constant + [tuple(np.inf * s if v is None else v for v, s in zip(bounds.get(x, (None, None)), (-1, 1), strict=True)) for x in xs]
    b = np.array([min(max(0.0, lo), hi) for lo, hi in limits])
    for _ in range(sweeps):
        old = b.copy()
        for j, (lo, hi) in enumerate(limits):
            if a[j, j] > 0:
                b[j] = min(max((c[j] - a[j] @ b + a[j, j] * b[j]) / a[j, j], lo), hi)
        if np.abs(b - old).max() <= 1e-12 * max(1.0, np.abs(b).max()):
            break
    rss = g[p, p] - 2 * b @ c + b @ a @ b
    tss = g[p, p] - g[0, p] ** 2 / g[0, 0] if constant else g[p, p]
    return Line(list(xs), b[1:] if constant else b, float(b[0]) if constant else 0.0, float(1 - rss / tss) if tss else 0.0, n)


def constrained_by_loss(df: DataFrame, y: str, xs: Sequence[str], bounds: dict[str, tuple[float | None, float | None]], loss: Callable[[Column], Column], slope: Callable[[Column], Column], constant: bool = True, rounds: int = 200) -> Line:
    """Least total loss(y - prediction) with a range per coefficient, for any convex loss with its derivative; one aggregate
    a step. Projected descent, scaled by the sums of squares, from the constrained least squares."""
    start = constrained(df, y, xs, bounds, constant)
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*xs, y])]).dropna()
    cols = [F.lit(1.0)] * constant + [F.col(x) for x in xs]
    limits = [(-np.inf, np.inf)] * constant + [tuple(np.inf * s if v is None else v for v, s in zip(bounds.get(x, (None, None)), (-1, 1), strict=True)) for x in xs]
    low, high = (np.array([v[k] for v in limits], dtype=float) for k in (0, 1))
    scale = np.array(rows.agg(*[F.sum(c * c) for c in cols]).first(), dtype=float)

    def at(b: np.ndarray) -> tuple[float, np.ndarray]:
        r = F.col(y)
        for c, v in zip(cols, b, strict=True):
            r = r - c * F.lit(float(v))
        got = rows.select(r.alias("__r"), *[c.alias(f"__c{j}") for j, c in enumerate(cols)])
        got = got.agg(F.sum(loss(F.col("__r"))), *[-F.sum(slope(F.col("__r")) * F.col(f"__c{j}")) for j in range(len(cols))]).first()
        return float(got[0]), np.array(got[1:], dtype=float)

    b = np.append([start.intercept] * constant, start.coefficients).astype(float)
    f, g = at(b)
    step = 1.0
    for _ in range(rounds):
        while step > 1e-12:
            new = np.clip(b - step * g / np.maximum(scale, 1e-300), low, high)
            fn, gn = at(new)
            if fn <= f - 0.1 * float((g * (b - new)).sum()):
                break
            step /= 2
        else:
            break
        done = f - fn <= 1e-10 * max(1.0, abs(f))
        b, f, g, step = new, fn, gn, step * 2
        if done:
            break
    return Line(list(xs), b[1:] if constant else b, float(b[0]) if constant else 0.0, float("nan"), start.rows)


def autoregression(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], lags: int) -> Line:
    """AR by least squares on lags within each series, pooled over series."""
    w = Window.partitionBy(*keys).orderBy(*order)
    lagged = df.select(value, *[F.lag(value, k).over(w).alias(f"lag{k}") for k in range(1, lags + 1)])
    return least_squares(lagged, value, [f"lag{k}" for k in range(1, lags + 1)])


def mean_reversion(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Ornstein-Uhlenbeck parameters of every series: theta = 1 - slope on the value before, mu = intercept / theta,
    sigma = population deviation of the residuals."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    pairs = df.withColumn("__x", before)
    y, x = value, "__x"
    out = pairs.groupBy(*keys).agg(F.regr_slope(y, x).alias("a1"), F.regr_intercept(y, x).alias("a0"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.regr_count(y, x).alias("n"))
    out = out.withColumn("theta", 1 - F.col("a1")).withColumn("mu", F.try_divide(F.col("a0"), F.col("theta")))
    var = F.try_divide(F.col("syy") - F.col("a1") * F.col("sxy"), F.col("n"))
    return out.withColumn("sigma", F.sqrt(F.greatest(var, F.lit(0.0)))).select(*keys, "theta", "mu", "sigma", "n")


def reversion_bands(parameters: DataFrame, k: float) -> DataFrame:
    """mu -/+ k * sigma / sqrt(2 theta - theta^2); null where the series doesn't revert."""
    v = 2 * F.col("theta") - F.col("theta") ** 2
    half = F.lit(float(k)) * F.col("sigma") / F.when(v > 0, F.sqrt(v))
    return parameters.withColumn("lower", F.col("mu") - half).withColumn("upper", F.col("mu") + half)


def product_of(columns: Sequence[str], without: str | None = None) -> Column:
    out = F.lit(1.0)
    for c in columns:
        if c != without:
            out = out * F.col(c)
    return out


def group_means(df: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(target).alias("prediction"))


def predict_group_means(df: DataFrame, fitted: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(fitted, list(keys), "left")


