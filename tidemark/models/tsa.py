"""Vector autoregressions, cointegration and tests, from distributed sums of lagged columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .linear import gram, solve


def _lagged(df: DataFrame, columns: Sequence[str], keys: Sequence[str], order: Sequence[str], lags: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.select(*columns, *[F.lag(c, j).over(w).alias(f"{c}__{j}") for j in range(1, lags + 1) for c in columns])


def vector_autoregression(df: DataFrame, columns: Sequence[str], keys: Sequence[str], order: Sequence[str], lags: int) -> dict:
    """Coefficients (constant first, then lag 1 of every series, lag 2, ...) and residual covariance."""
    k = len(columns)
    lag = [f"{c}__{j}" for j in range(1, lags + 1) for c in columns]
    g, n = gram(_lagged(df, columns, keys, order, lags), [F.lit(1.0), *map(F.col, lag), *map(F.col, columns)])
    p = 1 + len(lag)
    b = solve(g[:p, :p], g[:p, p:])
    cov = (g[p:, p:] - b.T @ g[:p, p:]) / (n - p)
    return {"coefficients": b, "covariance": (cov + cov.T) / 2, "rows": n, "series": k}


def error_correction(df: DataFrame, columns: Sequence[str], keys: Sequence[str], order: Sequence[str], lags: int = 1) -> dict:
    """Rank-one reduced-rank regression: the cointegration vector (first entry 1), loadings and eigenvalues."""
    w = Window.partitionBy(*keys).orderBy(*order)
    diff = df.select(*columns, *[(F.col(c) - F.lag(c).over(w)).alias(f"d_{c}") for c in columns], *[F.lag(c).over(w).alias(f"l_{c}") for c in columns], *keys, *order)
    past = [f"d_{c}__{j}" for j in range(1, lags + 1) for c in columns]
    wide = diff.select("*", *[F.lag(f"d_{c}", j).over(w).alias(f"d_{c}__{j}") for j in range(1, lags + 1) for c in columns])
    k = len(columns)
    g, n = gram(wide, [F.lit(1.0), *map(F.col, past), *[F.col(f"d_{c}") for c in columns], *[F.col(f"l_{c}") for c in columns]])
    q = 1 + len(past)
    r = g[q:, q:] - g[q:, :q] @ solve(g[:q, :q], g[:q, q:])
    s00, s01, s11 = r[:k, :k] / n, r[:k, k:] / n, r[k:, k:] / n
    m = np.linalg.solve(s11, s01.T @ np.linalg.solve(s00, s01))
    values, vectors = np.linalg.eig(m)
    top = int(np.argsort(-values.real)[0])
    beta = vectors[:, top].real
    beta = beta / beta[0]
    alpha = s01 @ beta / (beta @ s11 @ beta)
    return {"beta": beta, "alpha": alpha, "eigenvalues": np.sort(values.real)[::-1], "rows": n}


def integrated(df: DataFrame, columns: Sequence[str], beta: Sequence[float], out: str = "integrated") -> DataFrame:
    total = F.lit(0.0)
    for c, b in zip(columns, beta, strict=True):
        total = total + F.col(c) * F.lit(float(b))
    return df.withColumn(out, total)


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    head = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        i = a
        while abs(term) > 1e-16 * abs(total):
            i += 1
            term *= x / i
            total += term
        return 1 - head * total
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return head * h


def ljung_box(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], lags: int) -> DataFrame:
    """(keys, lag, q, p): n (n + 2) * sum of rho_k^2 / (n - k) up to each lag, with its chi-square tail."""
    w = Window.partitionBy(*keys).orderBy(*order)
    whole = Window.partitionBy(*keys)
    d = df.select(*keys, *order, (F.col(value) - F.avg(value).over(whole)).alias("d"))
    lagged = d.select(*keys, "d", *[F.lag("d", j).over(w).alias(f"d{j}") for j in range(1, lags + 1)])
    sums = lagged.groupBy(*keys).agg(F.count("d").alias("n"), F.sum(F.col("d") ** 2).alias("v"), *[F.sum(F.col("d") * F.col(f"d{j}")).alias(f"c{j}") for j in range(1, lags + 1)])
    q, rows = F.lit(0.0), []
    for j in range(1, lags + 1):
        q = q + F.try_divide(F.col(f"c{j}"), F.col("v")) ** 2 / (F.col("n") - j)
        rows.append(F.struct(F.lit(j).alias("lag"), (F.col("n") * (F.col("n") + 2) * q).alias("q")))
    out = sums.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.lag", "r.q")

    @F.pandas_udf("double")
    def tail(lag, q):
        return q.combine(lag, lambda v, j: gamma_upper(j / 2, v / 2) if v == v else None)

    return out.withColumn("p", tail("lag", "q"))


# 1, 5 and 10 percent points of the unit-root t distribution with a constant: limit, 1/n and 1/n^2 terms.
ADF_POINTS = {1: (-3.43035, -6.5393, -16.786), 5: (-2.86154, -2.8903, -4.234), 10: (-2.56677, -1.5384, -2.809)}


def adf(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], lags: int = 1) -> dict:
    """Augmented unit-root test with a constant: t statistic and its critical values."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.select(*keys, *order, (F.col(value) - F.lag(value).over(w)).alias("d"), F.lag(value).over(w).alias("level"))
    wide = d.select("d", "level", *[F.lag("d", j).over(w).alias(f"d{j}") for j in range(1, lags + 1)])
    g, n = gram(wide, [F.lit(1.0), F.col("level"), *[F.col(f"d{j}") for j in range(1, lags + 1)], F.col("d")])
    p = 2 + lags
    b = solve(g[:p, :p], g[:p, p])
    rss = g[p, p] - b @ g[:p, p]
    se = math.sqrt(max(0.0, rss / (n - p) * np.linalg.inv(g[:p, :p])[1, 1]))
    return {"t": float(b[1] / se), "rows": n, "critical": {k: a + b1 / n + b2 / n**2 for k, (a, b1, b2) in ADF_POINTS.items()}}
