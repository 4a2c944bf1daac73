"""Curve fits on pre-aggregated points: smooth monotone curves, bounded nonlinear fits, hinges, L-BFGS."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import curves
from ..operators import smoothing


def interpolation_matrix(x: np.ndarray, grid: np.ndarray) -> np.ndarray:
    i = np.clip(np.searchsorted(grid, x, side="right") - 1, 0, len(grid) - 2)
    t = np.clip((x - grid[i]) / (grid[i + 1] - grid[i]), 0, 1)
    out = np.zeros((len(x), len(grid)))
    out[np.arange(len(x)), i] = 1 - t
    out[np.arange(len(x)), i + 1] = t
    return out


def smooth_monotone(x: Sequence[float], y: Sequence[float], w: Sequence[float], grid: Sequence[float], alpha: float = 1.0, direction: int = -1, rounds: int = 4000) -> np.ndarray:
    """Grid values of least weighted squares plus alpha times squared second differences, monotone in direction (0: free).

    Solved as a sum of steps of one sign, by projected coordinate descent on the normal equations.
    """
    g = np.asarray(grid, float)
    a = interpolation_matrix(np.asarray(x, float), g)
    d = np.diff(np.eye(len(g)), n=2, axis=0)
    h = a.T @ (np.asarray(w, float)[:, None] * a) + alpha * d.T @ d + 1e-10 * np.eye(len(g))
    c = a.T @ (np.asarray(w, float) * np.asarray(y, float))
    if not direction:
        return np.linalg.solve(h, c)
    t = np.tril(np.ones((len(g), len(g))))  # values = level and cumulated steps
    t[:, 1:] *= direction
    m, v = t.T @ h @ t, t.T @ c
    s = np.linalg.solve(m, v)
    s[1:] = np.maximum(s[1:], 0)
    for _ in range(rounds):
        old = s.copy()
        for j in range(len(s)):
            s[j] += (v[j] - m[j] @ s) / m[j, j]
            if j:
                s[j] = max(s[j], 0.0)
        if np.abs(s - old).max() < 1e-11 * max(1.0, np.abs(s).max()):
            break
    return t @ s


def fit_curve(f: Callable[..., np.ndarray], x: Sequence[float], y: Sequence[float], start: Sequence[float], low: Sequence[float] | None = None, high: Sequence[float] | None = None, sigma: Sequence[float] | None = None, rounds: int = 500) -> np.ndarray:
    """Bounded nonlinear least squares by damped Gauss-Newton steps with numeric derivatives."""
    x, y, p = np.asarray(x, float), np.asarray(y, float), np.asarray(start, float)
    s = np.ones(len(x)) if sigma is None else np.asarray(sigma, float)
    lo = np.full(len(p), -np.inf) if low is None else np.asarray(low, float)
    hi = np.full(len(p), np.inf) if high is None else np.asarray(high, float)
    res = lambda q: (f(x, *q) - y) / s
    r, damp = res(p), 1e-3
    for _ in range(rounds):
        j = np.empty((len(x), len(p)))
        for i in range(len(p)):
            h = 1e-7 * max(1.0, abs(p[i]))
            q = p.copy()
            q[i] += h
            j[:, i] = (res(q) - r) / h
        m, g = j.T @ j, j.T @ r
        for _ in range(30):
            step = np.linalg.lstsq(m + damp * np.diag(np.maximum(np.diag(m), 1e-12)), -g, rcond=None)[0]
            q = np.clip(p + step, lo, hi)
            rq = res(q)
            if np.isfinite(rq).all() and rq @ rq < r @ r:
                break
            damp *= 4
        else:
            return p
        done = (r @ r - rq @ rq) <= 1e-14 * max(1e-300, r @ r)
        p, r, damp = q, rq, damp / 6
        if done:
            break
    return p


def points_of(df: DataFrame, x: str, y: str, weight: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, x, y, w): weighted means at each x, which carry all that least squares needs."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(x).cast("double").alias("x")).agg((F.sum(w * F.col(y)) / F.sum(w)).alias("y"), F.sum(w).alias("w"))


def fit_groups(points: DataFrame, keys: Sequence[str], f: Callable[..., np.ndarray], names: Sequence[str], start: Sequence[float], low=None, high=None) -> DataFrame:
    """One nonlinear fit per key over pre-aggregated points."""
    import pandas as pd

    kinds = {c.name: c.dataType.simpleString() for c in points.schema}
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], *[f"{n} double" for n in names]])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        p = fit_curve(f, g["x"], g["y"], start, low, high, 1 / np.sqrt(g["w"].to_numpy()))
        return pd.DataFrame([[*[g[k].iloc[0] for k in keys], *p]], columns=[*keys, *names])

    return points.groupBy(*keys).applyInPandas(run, schema)


def monotone_curve(df: DataFrame, x: str, y: str, date: str, as_of: Column, cutoffs: Sequence[float], grid: Sequence[float], alpha: float = 1.0, life: float = 14.0):
    """A time-weighted, binned, smooth falling curve as a function of a column."""
    from ..operators.aggs import decayed_means

    rows = sorted(decayed_means(df, x, y, date, cutoffs, as_of, life).collect(), key=lambda r: r["point"])  # one row a bin
    values = smooth_monotone([r["point"] for r in rows], [r["value"] for r in rows], [r["count"] for r in rows], grid, alpha)
    return lambda c: curves.pchip(c, list(map(float, grid)), list(map(float, values)))


def fit_hinge(df: DataFrame, x: str, y: str, low: float, high: float, knots: Sequence[float], weight: str | None = None, smooth: float = 0.0, monotone: int = 0) -> dict:
    """Level, slope and bend weights of a hinge by least squares; monotone: 1 rises, -1 falls, 0 free."""
    from .linear import gram

    g, n = gram(df, [*hinge_terms(x, low, high, knots), F.col(y)], F.col(weight) if weight else None)
    return solve_hinge(g, n, low, high, knots, smooth, monotone)


def hinge_terms(x: str, low: float, high: float, knots: Sequence[float]) -> list[Column]:
    """Constant, x scaled to 0..1 and held there, and its bends: the columns that a hinge is linear in."""
    z = (F.least(F.greatest(F.col(x).cast("double"), F.lit(float(low))), F.lit(float(high))) - F.lit(float(low))) / F.lit(float(high - low))
    return [F.lit(1.0), z, *[F.greatest(z - F.lit(float(t)), F.lit(0.0)) for t in knots]]


def solve_hinge(g: np.ndarray, n: int, low: float, high: float, knots: Sequence[float], smooth: float = 0.0, monotone: int = 0) -> dict:
    """The hinge of the sums of products of its terms and, last, the target."""
    p = len(g) - 1
    pen = np.diag([0.0, 0.0, *[smooth * n] * len(knots)]) + 1e-9 * np.eye(p)
    h, c = g[:p, :p] + pen, g[:p, p]
    if not monotone:
        b = np.linalg.solve(h, c)
    else:  # slopes of the segments share a sign: write bends as differences of slopes
        t = np.eye(p)
        for j in range(2, p):
            t[j, j - 1] = -1
        m, v = t.T @ h @ t, t.T @ c
        s = np.zeros(p)
        for _ in range(5000):
            old = s.copy()
            for j in range(p):
                s[j] += (v[j] - m[j] @ s) / m[j, j]
                if j:
                    s[j] = monotone * max(monotone * s[j], 0.0)
            if np.abs(s - old).max() < 1e-12:
                break
        b = t @ s
    return {"low": low, "high": high, "level": float(b[0]), "slope": float(b[1]), "knots": list(map(float, knots)), "weights": list(map(float, b[2:]))}


def lbfgs(value_and_gradient: Callable[[np.ndarray], tuple[float, np.ndarray]], start: Sequence[float], rounds: int = 200, memory: int = 10, tol: float = 1e-9) -> np.ndarray:
    """Limited-memory quasi-Newton descent; the function may run a distributed aggregate."""
    x = np.asarray(start, float)
    f, g = value_and_gradient(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, alphas = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            q -= a * y
            alphas.append(a)
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(alphas), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        step, slope = 1.0 if pairs else min(1.0, 1 / max(1e-12, np.abs(g).sum())), -(g @ q)
        for _ in range(40):
            new = x - step * q
            fn, gn = value_and_gradient(new)
            if np.isfinite(fn) and fn <= f + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = new - x, gn - g
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        done = abs(f - fn) <= tol * max(1.0, abs(f))
        x, f, g = new, fn, gn
        if done:
            break
    return x


def adam(value_and_gradient: Callable[[np.ndarray], tuple[float, np.ndarray]], start: Sequence[float], rounds: int = 500, rate: float = 0.05, tol: float = 1e-10) -> np.ndarray:
    """Adaptive-moment descent (decays 0.9 and 0.999); the best point seen."""
    x = np.asarray(start, float).copy()
    best, at, m, v = np.inf, x.copy(), np.zeros_like(x), np.zeros_like(x)
    for k in range(1, rounds + 1):
        f, g = value_and_gradient(x)
        if f < best:
            best, at = f, x.copy()
        if np.abs(g).max(initial=0.0) <= tol:
            break
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return at


def frozen(value_and_gradient: Callable[[np.ndarray], tuple[float, np.ndarray]], start: Sequence[float], held: Sequence[int]) -> tuple[Callable, np.ndarray, Callable]:
    """(function of the free parameters only, their start, free -> all) with the parameters at held kept as they start."""
    whole = np.asarray(start, float)
    free = np.setdiff1d(np.arange(len(whole)), np.asarray(held, int))

    def back(x: np.ndarray) -> np.ndarray:
        out = whole.copy()
        out[free] = x
        return out

    def inner(x: np.ndarray) -> tuple[float, np.ndarray]:
        f, g = value_and_gradient(back(x))
        return f, np.asarray(g)[free]

    return inner, whole[free], back


def isotonic(values: Sequence[float], weights: Sequence[float] | None = None, rising: bool = True) -> np.ndarray:
    return -smoothing.falling([-v for v in values], weights) if rising else smoothing.falling(values, weights)


def time_weighted_trees(df: DataFrame, features: Sequence[str], target: str, date: str, rate: float, offset: float, rounds: int = 20, depth: int = 4, seed: int = 1):
    """Gradient-boosted trees with logistic recency weights; returns a fitted pipeline model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    from ..operators.windows import recency_weights

    rows = recency_weights(df, date, rate, offset, "__w")
    trees = GBTRegressor(featuresCol="__x", labelCol=target, weightCol="__w", maxIter=rounds, maxDepth=depth, seed=seed, predictionCol="prediction")
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="__x"), trees]).fit(rows)
