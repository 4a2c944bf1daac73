"""Standard errors and starts of fits whose loss isn't a square: every pass is one aggregate over the rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linear import gram, solve


def _score(xs: Sequence[str], beta: np.ndarray) -> Column:
    out = F.lit(0.0)
    for x, b in zip(xs, beta, strict=True):
        out = out + F.col(x) * F.lit(float(b))
    return out


def _errors(information: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, np.diag(np.linalg.pinv(information))))


def logistic(df: DataFrame, y: str, xs: Sequence[str], rounds: int = 25, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, standard errors) of a logistic fit without a constant by Newton steps; y is 0 or 1."""
    k, beta = len(xs), np.zeros(len(xs))
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-_score(xs, beta)))
        w = F.greatest(p * (1 - p), F.lit(1e-12))
        g, _n = gram(df, [*map(F.col, xs), (F.col(y) - p) / w], w)
        step = solve(g[:k, :k], g[:k, k])
        beta = beta + step
        if np.abs(step).max() < tol:
            break
    return beta, logistic_errors(df, xs, beta)


def logistic_errors(df: DataFrame, xs: Sequence[str], beta: np.ndarray) -> np.ndarray:
    p = 1 / (1 + F.exp(-_score(xs, beta)))
    return _errors(gram(df, [*map(F.col, xs)], p * (1 - p))[0])


def cross_entropy_errors(df: DataFrame, y: str, xs: Sequence[str], beta: np.ndarray, least: float = 1e-6) -> np.ndarray:
    """Of coefficients whose product with xs is the probability itself, held to [least, 1 - least]; rows held at an end
    tell nothing."""
    z = _score(xs, beta)
    inside = df.where((z > least) & (z < 1 - least))
    return _errors(gram(inside, [*map(F.col, xs)], F.col(y) / z**2 + (1 - F.col(y)) / (1 - z) ** 2)[0])


def numerical_hessian(f: Callable[[np.ndarray], float], x: np.ndarray, step: float = 1e-4) -> np.ndarray:
    """Second derivatives of f at x by central differences."""
    x = np.asarray(x, dtype=float)
    h = step * np.maximum(1.0, np.abs(x))
    e = np.diag(h)
    out = np.empty((len(x), len(x)))
    for i in range(len(x)):
        for j in range(i, len(x)):
            d = f(x + e[i] + e[j]) - f(x + e[i] - e[j]) - f(x - e[i] + e[j]) + f(x - e[i] - e[j])
            out[i, j] = out[j, i] = d / (4 * h[i] * h[j])
    return out


def mean_matched(df: DataFrame, xs: Sequence[str], mean: float) -> np.ndarray:
    """Coefficients along the columns' means whose average prediction is mean."""
    row = df.agg(*[F.avg(x) for x in xs]).first()
    c = np.array([v or 0.0 for v in row], dtype=float)
    if not c.any():
        raise ValueError("all column means are zero")
    return mean / float(c @ c) * c
