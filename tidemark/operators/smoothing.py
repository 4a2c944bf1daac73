"""Imputation, smoothing, constraint repair, keyed memory and kernel curves."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import nulls
from .windows import Names, series


def rolling_ridge_impute(df: DataFrame, y: str, x: str, keys: Names, order: Names, span: int, alpha: float, out: str = "imputed") -> DataFrame:
    """y predicted at each row from x by a ridge line over the span rows before it, weights exp(-linspace(0, 1, n)) with
    the newest 1. With under span // 2 observed rows the last line is used again; the first span rows stay missing."""

    def make(f):
        a, b = f[x].to_numpy(dtype=float), f[y].to_numpy(dtype=float)
        got, line = np.full(len(a), np.nan), None
        for t in range(span, len(a)):
            u, v = a[t - span : t], b[t - span : t]
            ok = ~np.isnan(u) & ~np.isnan(v)
            n = int(ok.sum())
            if n >= max(1, span // 2):
                w = np.exp(-np.linspace(0, 1, n))[::-1]
                mu, mv = np.average(u[ok], weights=w), np.average(v[ok], weights=w)
                slope = (w * (u[ok] - mu) * (v[ok] - mv)).sum() / ((w * (u[ok] - mu) ** 2).sum() + alpha)
                line = slope, mv - slope * mu
            if line is not None:
                got[t] = line[0] * a[t] + line[1]
        return {out: got}

    return series(df, keys, order, {out: "double"}, make)


def smoothed(v: np.ndarray, lam: float) -> np.ndarray:
    """Columns of v solved for (I + lam D'D), D the steps between rows: one sweep down and one up."""
    n = len(v)
    main = np.full(n, 1 + 2 * lam)
    main[[0, -1]] = 1 + lam if n > 1 else 1.0
    out, ratio = np.array(v, dtype=float), np.zeros(n)
    for i in range(n):
        pivot = main[i] + (lam * ratio[i - 1] if i else 0.0)
        ratio[i] = -lam / pivot
        out[i] = (out[i] + (lam * out[i - 1] if i else 0.0)) / pivot
    for i in range(n - 2, -1, -1):
        out[i] -= ratio[i] * out[i + 1]
    return out


def smooth_spread_impute(df: DataFrame, y: str, x: str, keys: Names, order: Names, lam: float, out: str = "imputed") -> DataFrame:
    """y = b x + s with s smooth between observed rows: least squares of the fit plus lam times squared steps of s, solved
    exactly in time and memory linear in the series; s is carried forward, and back before the first observed row. Where
    x doesn't change, b is 0."""

    def make(f):
        a, b = f[x].to_numpy(dtype=float), f[y].to_numpy(dtype=float)
        at = np.flatnonzero(~np.isnan(a) & ~np.isnan(b))
        if not len(at):
            return {out: np.full(len(a), np.nan)}
        n, xs, ys = len(at), a[at], b[at]
        smooth = smoothed(np.column_stack([xs, ys]), lam)
        free = xs @ xs - xs @ smooth[:, 0]  # what of x isn't smooth
        slope = (xs @ ys - xs @ smooth[:, 1]) / free if free > 1e-12 * max(1.0, xs @ xs) else 0.0
        s = smooth[:, 1] - slope * smooth[:, 0]
        place = np.clip(np.searchsorted(at, np.arange(len(a)), side="right") - 1, 0, n - 1)
        return {out: slope * a + s[place]}

    return series(df, keys, order, {out: "double"}, make)


def savgol(df: DataFrame, value: str, keys: Names, order: Names, window: int, degree: int, out: str = "smooth") -> DataFrame:
    """Savitzky-Golay: a local polynomial at the middle of an odd window; at the ends, the end window's polynomial."""
    if window % 2 == 0 or degree >= window:
        raise ValueError("window must be odd and over the degree")
    half = window // 2
    design = np.vander(np.arange(-half, half + 1), degree + 1, increasing=True)
    taps = np.linalg.pinv(design)

    def make(f):
        v = f[value].to_numpy(dtype=float)
        if len(v) < window:
            return {out: np.full(len(v), np.nan)}
        got = np.convolve(v, taps[0][::-1], mode="same")
        for part, spots in ((v[:window], range(half)), (v[-window:], range(-half, 0))):
            c = taps @ part
            for i in spots:
                z = i - half if i >= 0 else i + half + 1
                got[i] = sum(c[p] * z**p for p in range(degree + 1))
        return {out: got}

    return series(df, keys, order, {out: "double"}, make)


def repair_order(df: DataFrame, senior_to_junior: Names, bands: Sequence[tuple[str, str, float, float]] = (), gap: float = 0.01) -> DataFrame:
    """Per row: a junior series that lies under a senior one is moved gap above it, and each band (junior - senior in
    [low, high]) moves the junior. Pairs are visited from senior to junior. Adds repairs, an array of texts."""
    now: dict[str, Column] = {c: F.col(c) for c in senior_to_junior}
    logs: list[Column] = []
    pairs = {(a, b): (None, None) for a, b in zip(senior_to_junior, senior_to_junior[1:], strict=False)}
    for senior in senior_to_junior:
        for a, b in pairs:
            if senior in (a, b):
                df, now, logs = _repair(df, now, logs, a, b, now[a] > now[b], lambda s, j: s + F.lit(gap))
        for a, b, low, high in bands:
            if senior in (a, b):
                df, now, logs = _repair(df, now, logs, a, b, (now[b] - now[a]) < low, lambda s, j, low=low: s + F.lit(float(low)))
                df, now, logs = _repair(df, now, logs, a, b, (now[b] - now[a]) > high, lambda s, j, high=high: s + F.lit(float(high)))
    names = df.columns
    out = df.withColumn("repairs", F.filter(F.array(*logs), lambda v: v.isNotNull()) if logs else F.array().cast("array<string>"))
    final = {c: now[c] for c in senior_to_junior}
    return out.withColumns(final).select(*[c for c in names if not c.startswith("__r")], "repairs")


def _repair(df: DataFrame, now: dict, logs: list, a: str, b: str, wrong: Column, to) -> tuple:
    """Each step's value is a column of its own, so that expressions don't double in size from step to step."""
    i = len(logs)
    df = df.withColumn(f"__r{i}", F.when(nulls.holds(wrong), to(now[a], now[b])).otherwise(now[b]))
    logs = [*logs, F.when(nulls.holds(wrong), F.lit(f"{b} moved against {a}"))]
    return df, {**now, b: F.col(f"__r{i}")}, logs


def keyed_memory(df: DataFrame, residual: str, day: str, keys: Names, tie: Names, alpha: float, shrink: float, life: float) -> DataFrame:
    """Look-ahead free memory of each key: before a row, ema and n decay by the gap in days; adjustment = n / (n + shrink)
    * ema; then the row enters. Adds adjustment, ema and n after the row. Rows with a missing residual only decay."""

    def make(f):
        day_no = (f[day].astype("datetime64[ns]").astype("int64") // 86_400_000_000_000).to_numpy()
        r = f[residual].to_numpy(dtype=float)
        return dict(zip(("adjustment", "ema", "n"), memory_fold(day_no, r, alpha, shrink, life), strict=True))

    return series(df, keys, [day, *tie], {"adjustment": "double", "ema": "double", "n": "double"}, make)


def memory_state(memory: DataFrame, day: str, keys: Names, tie: Names) -> DataFrame:
    """(keys, ema, n, last_day) after each key's last row."""
    last = F.max_by(F.struct("ema", "n"), F.struct(day, *tie))
    return memory.groupBy(*keys).agg(last.alias("s"), F.max(day).alias("last_day")).select(*keys, "s.ema", "s.n", "last_day")


def resume_memory(df: DataFrame, state: DataFrame, residual: str, day: str, key: str, tie: Names, alpha: float, shrink: float, life: float) -> DataFrame:
    """keyed_memory of new rows that goes on from a state table; keys without state start anew."""
    names = list(df.columns)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], "adjustment double, ema double, n double"])
    number = lambda c: (c.astype("datetime64[ns]").astype("int64") // 86_400_000_000_000).to_numpy()

    def run(new, old):
        if not len(new):
            return new.assign(adjustment=[], ema=[], n=[])
        new = new.sort_values([day, *tie])
        start = (float(old["ema"].iloc[0]), float(old["n"].iloc[0]), int(number(old["last_day"])[0])) if len(old) else (0.0, 0.0, None)
        out = memory_fold(number(new[day]), new[residual].to_numpy(dtype=float), alpha, shrink, life, start)
        return new[names].assign(adjustment=out[0], ema=out[1], n=out[2])

    return df.groupBy(key).cogroup(state.select(key, "ema", "n", "last_day").groupBy(key)).applyInPandas(run, schema)


def memory_fold(days, residuals, alpha: float, shrink: float, life: float, state=(0.0, 0.0, None)):
    """(adjustments, emas, ns) of a series from a state (ema, n, last day)."""
    ema, n, last = state
    out = np.zeros((3, len(days)))
    for i, (d, r) in enumerate(zip(days, residuals, strict=True)):
        if last is not None and d > last:
            keep = math.exp(-math.log(2) / life * (d - last))
            ema, n = ema * keep, n * keep
        out[0, i] = n / (n + shrink) * ema if n + shrink > 0 else 0.0
        if r == r:
            ema, n = (alpha * r + (1 - alpha) * ema if n > 0 else alpha * r), n + 1
        last = d if last is None else max(last, d)
        out[1, i], out[2, i] = ema, n
    return out


def kernel_curves(df: DataFrame, keys: Names, x: str, y: str, grid: Sequence[float], width: float) -> DataFrame:
    """(keys, grid_x, delta): Gaussian-kernel mean of y at each grid point, times the confidence 1 - exp(-sum of weights).
    The grid is fixed, so that each row adds len(grid) terms to pre-aggregated sums and nothing is expanded."""
    terms = []
    for i, g in enumerate(grid):
        w = F.exp(-((F.col(x) - F.lit(float(g))) / F.lit(float(width))) ** 2 / 2)
        w = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), w)
        terms += [F.sum(w).alias(f"w{i}"), F.sum(w * F.col(y)).alias(f"s{i}")]
    sums = df.groupBy(*keys).agg(*terms)
    points = F.explode(F.array(*[F.struct(F.lit(float(g)).alias("grid_x"), (F.try_divide(f"s{i}", f"w{i}") * (1 - F.exp(-F.col(f"w{i}")))).alias("delta")) for i, g in enumerate(grid)]))
    return sums.select(*keys, points.alias("p")).select(*keys, "p.grid_x", F.coalesce("p.delta", F.lit(0.0)).alias("delta"))


def local_linear(df: DataFrame, keys: Names, x: str, y: str, grid: Sequence[float], width: float) -> DataFrame:
    """(keys, grid_x, value): kernel-weighted line through the rows at each grid point."""
    terms = []
    for i, g in enumerate(grid):
        z = F.col(x) - F.lit(float(g))
        w = F.exp(-((z / F.lit(float(width))) ** 2) / 2)
        terms += [F.sum(w * t).alias(f"{n}{i}") for n, t in (("a", F.lit(1.0)), ("b", z), ("c", z * z), ("d", F.col(y)), ("e", z * F.col(y)))]
    sums = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(*terms)

    def value(i: int) -> Column:
        a, b, c, d, e = (F.col(f"{n}{i}") for n in "abcde")
        return F.coalesce(F.try_divide(c * d - b * e, a * c - b * b), F.try_divide(d, a))

    points = F.explode(F.array(*[F.struct(F.lit(float(g)).alias("grid_x"), value(i).alias("value")) for i, g in enumerate(grid)]))
    return sums.select(*keys, points.alias("p")).select(*keys, "p.grid_x", "p.value")


def falling(values: Sequence[float], weights: Sequence[float] | None = None) -> np.ndarray:
    """Isotonic decreasing fit by pooling adjacent violators."""
    w = np.ones(len(values)) if weights is None else np.asarray(weights, float)
    stack: list[list[float]] = []
    for v, k in zip(values, w, strict=True):
        stack.append([float(v), float(k), 1])
        while len(stack) > 1 and stack[-2][0] < stack[-1][0]:
            v2, k2, n2 = stack.pop()
            v1, k1, n1 = stack.pop()
            stack.append([(v1 * k1 + v2 * k2) / (k1 + k2), k1 + k2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in stack]) if stack else np.empty(0)


def daily_curves(df: DataFrame, day: str, bucket: str, x: str, y: str, grid: Sequence[float], width: float, blend: float = 1.0, base: Sequence[float] | None = None, start: DataFrame | None = None) -> DataFrame:
    """(bucket, day, curve): kernel curves blended with the day before and, with a base, made so that base + curve falls.
    From its first day on, days of other buckets on which a bucket has no rows carry its curve on. start: curves of earlier
    days to go on from."""
    raw = kernel_curves(df, [bucket, day], x, y, grid, width).groupBy(bucket, day).agg(F.array_sort(F.collect_list(F.struct("grid_x", "delta"))).alias("points"))
    days = df.select(day).where(F.col(day).isNotNull()).distinct()
    days = days.withColumn("__rank", F.row_number().over(Window.orderBy(day)))  # one row per day
    raw = raw.join(days, day).select(bucket, "__rank", F.transform("points", lambda p: p["delta"]).alias("raw"))
    # Each bucket's own range of days, up to the day before its next curve (or the last day of all), as rows.
    after = F.lead("__rank").over(Window.partitionBy(bucket).orderBy("__rank"))
    top = days.agg(F.max("__rank").alias("__top"))
    spans = raw.withColumn("__next", after).crossJoin(F.broadcast(top)).withColumn("__next", F.coalesce("__next", F.col("__top") + 1))
    full = spans.withColumn("__day", F.explode(F.sequence("__rank", F.col("__next") - 1)))
    full = full.select(bucket, F.col("__day").alias("__rank"), F.when(F.col("__day") == F.col("__rank"), F.col("raw")).alias("raw")).join(days, "__rank").drop("__rank")
    if start is None:
        full = full.withColumn("held", F.lit(None).cast("array<double>"))
    else:
        full = full.join(start.groupBy(bucket).agg(F.max_by("curve", day).alias("held")), bucket, "left")

    def make(f):
        held = f["held"].iloc[0]
        out, last = [], np.zeros(len(grid)) if held is None else np.asarray(held, float)
        for raw in f["raw"]:
            if raw is not None:
                now = blend * np.asarray(raw, float) + (1 - blend) * last
                last = falling(np.asarray(base) + now) - np.asarray(base) if base is not None else now
            out.append(last.tolist())
        return {"curve": out}

    return series(full, [bucket], [day], {"curve": "array<double>"}, make).drop("raw", "held")


def curve_value(curve: Column | str, x: Column | str, low: float, high: float, n: int) -> Column:
    """Linear interpolation in a curve on n even grid points, held at its ends."""
    c, z = nulls.col(curve), (nulls.clip(x, low, high) - F.lit(float(low))) / F.lit((high - low) / (n - 1))
    i = F.least(F.floor(z), F.lit(n - 2)).cast("int")
    return F.get(c, i) + (z - i) * (F.get(c, i + 1) - F.get(c, i))
