"""Curves as column expressions: parametric forms, interpolation, splines, hinges, ramps, bumps and gates."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import clip, col


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def sigmoid(x, low, high, slope, mid) -> Column:
    return F.lit(low) + F.lit(high - low) * logistic(F.lit(slope) * (col(x) - F.lit(mid)))


def bathtub(x, a, b, c, d, e) -> Column:
    """Falling exponential, floor and rising exponential."""
    x = col(x)
    return F.lit(a) * F.exp(-F.lit(b) * x) + F.lit(c) + F.lit(d) * F.exp(F.lit(e) * x)


def asymmetric_quadratic(x, mid, left, right, level) -> Column:
    z = col(x) - F.lit(mid)
    return F.lit(level) + F.when(z < 0, F.lit(left) * z * z).otherwise(F.lit(right) * z * z)


def double_logistic(x, low, high1, slope1, mid1, high2, slope2, mid2) -> Column:
    x = col(x)
    return F.lit(low) + F.lit(high1) * logistic(F.lit(slope1) * (x - mid1)) + F.lit(high2) * logistic(F.lit(slope2) * (x - mid2))


def hill(x, top, half, power) -> Column:
    p = F.pow(F.greatest(col(x), F.lit(0.0)), F.lit(power))
    return F.lit(top) * p / (F.lit(half**power) + p)


def double_hill(x, base, top1, half1, power1, top2, half2, power2) -> Column:
    return F.lit(base) + hill(x, top1, half1, power1) + hill(x, top2, half2, power2)


def double_exponential(x, a, b, c, d) -> Column:
    x = col(x)
    return F.lit(a) * F.exp(F.lit(b) * x) + F.lit(c) * F.exp(F.lit(d) * x)


def exponential_plateau(x, start, plateau, rate) -> Column:
    return F.lit(plateau) - F.lit(plateau - start) * F.exp(-F.lit(rate) * col(x))


def stretched_exponential(x, level, scale, tau, beta) -> Column:
    return F.lit(level) + F.lit(scale) * F.exp(-F.pow(F.greatest(col(x), F.lit(0.0)) / F.lit(tau), F.lit(beta)))


def in_range(form, x, span: tuple[float, float], extrapolate: bool = False, **parameters) -> Column:
    """A form at x, which is held to the fitted span unless extrapolation is allowed."""
    return form(col(x) if extrapolate else clip(x, *span), **parameters)


def _segments(x: Column, knots: Sequence[float], pieces: Sequence[Column], below: Column, above: Column) -> Column:
    out = F.when(x < F.lit(float(knots[0])), below)
    for k, piece in zip(knots[1:], pieces, strict=True):
        out = out.when(x <= F.lit(float(k)), piece)
    return F.when(x.isNotNull(), out.otherwise(above))


#: Curves of more pieces than this look their coefficients up in constant arrays, so that generated code stays small.
MANY = 8


def _piece(x: Column, knots: np.ndarray) -> Column:
    """Number of the piece that holds x, from 0; the first and last ones beyond the ends."""
    step = (knots[-1] - knots[0]) / (len(knots) - 1)
    if np.allclose(np.diff(knots), step, rtol=1e-9, atol=0):
        at = F.floor((x - F.lit(float(knots[0]))) / F.lit(float(step))).cast("int")
    else:
        at = F.size(F.filter(F.array(*[F.lit(float(k)) for k in knots]), lambda k: k < x)) - 1
    return F.least(F.greatest(at, F.lit(0)), F.lit(len(knots) - 2))


def _looked_up(x: Column, xs: Sequence[float], coefficients: Sequence[Sequence[float]], below: Column, above: Column) -> Column:
    """Polynomials in x - xs[i] (constant term first) of the piece that holds x."""
    knots = np.asarray(xs, float)
    at = _piece(x, knots)
    pick = lambda values: F.get(F.array(*[F.lit(float(v)) for v in values]), at)
    z, out = x - pick(knots), F.lit(0.0)
    for row in reversed(list(zip(*coefficients, strict=True))):
        out = out * z + pick(row)
    return F.when(x < F.lit(float(knots[0])), below).when(x > F.lit(float(knots[-1])), above).when(x.isNotNull(), out)


def interpolate(x, xs: Sequence[float], ys: Sequence[float], tails: str = "flat") -> Column:
    """Piecewise linear; tails flat or linear."""
    x, n = col(x).cast("double"), len(xs)
    slopes = [(ys[i + 1] - ys[i]) / (xs[i + 1] - xs[i]) for i in range(n - 1)]
    pieces = [F.lit(float(ys[i])) + F.lit(float(slopes[i])) * (x - F.lit(float(xs[i]))) for i in range(n - 1)]
    flat = tails == "flat" or n < 2
    below = F.lit(float(ys[0])) if flat else pieces[0]
    above = F.lit(float(ys[-1])) if flat else pieces[-1]
    if n > MANY:
        return _looked_up(x, xs, list(zip(ys[:-1], slopes, strict=True)), below, above)
    return _segments(x, xs, pieces, below, above)


def pchip_slopes(xs: Sequence[float], ys: Sequence[float]) -> np.ndarray:
    """Derivatives at the knots by weighted harmonic means, so that the curve is monotone where the knots are."""
    x, y = np.asarray(xs, float), np.asarray(ys, float)
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    if len(x) == 2:
        return np.array([d[0], d[0]])
    out = np.zeros(len(x))
    inner = d[:-1] * d[1:] > 0
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = (w1 + w2) / (w1 / d[:-1] + w2 / d[1:])
    out[1:-1] = np.where(inner, mean, 0.0)
    for at, (h0, h1, d0, d1) in ((0, (h[0], h[1], d[0], d[1])), (-1, (h[-1], h[-2], d[-1], d[-2]))):
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        out[at] = 0.0 if s * d0 <= 0 else 3 * d0 if d0 * d1 < 0 and abs(s) > 3 * abs(d0) else s
    return out


def cubic(x, xs, ys, slopes, tails: str = "flat") -> Column:
    """Cubic Hermite pieces with given knot values and slopes."""
    x, pieces, rows = col(x).cast("double"), [], []
    for i in range(len(xs) - 1):
        h = xs[i + 1] - xs[i]
        d = (ys[i + 1] - ys[i]) / h
        c2, c3 = (3 * d - 2 * slopes[i] - slopes[i + 1]) / h, (slopes[i] + slopes[i + 1] - 2 * d) / h**2
        rows.append((ys[i], slopes[i], c2, c3))
        z = x - F.lit(float(xs[i]))
        pieces.append(F.lit(float(ys[i])) + z * (F.lit(float(slopes[i])) + z * (F.lit(float(c2)) + z * F.lit(float(c3)))))
    flat = tails == "flat"
    below = F.lit(float(ys[0])) + (F.lit(0.0) if flat else F.lit(float(slopes[0])) * (x - F.lit(float(xs[0]))))
    above = F.lit(float(ys[-1])) + (F.lit(0.0) if flat else F.lit(float(slopes[-1])) * (x - F.lit(float(xs[-1]))))
    return _looked_up(x, xs, rows, below, above) if len(rows) > MANY else _segments(x, xs, pieces, below, above)


def pchip(x, xs, ys, tails: str = "flat") -> Column:
    return cubic(x, xs, ys, pchip_slopes(xs, ys), tails)


def surface(x, y, xs: Sequence[float], ys: Sequence[float], z: Sequence[Sequence[float]]) -> Column:
    """Monotone cubic along x on every grid line of y, then linear along y between its neighbours; both are held to the
    grid. The coefficients of a cell are looked up in constant arrays, so that the expression doesn't grow with the grid."""
    a, b = clip(x, xs[0], xs[-1]), clip(y, ys[0], ys[-1])
    u, v, grid = np.asarray(xs, float), np.asarray(ys, float), np.asarray(z, float)
    h, rows = np.diff(u), []
    for values in grid.T:
        m, d = pchip_slopes(u, values), np.diff(values) / h
        rows.append((values[:-1], m[:-1], (3 * d - 2 * m[:-1] - m[1:]) / h, (m[:-1] + m[1:] - 2 * d) / h**2))
    cells = np.stack([np.stack(r) for r in rows], axis=-1)  # power, piece of x, line of y
    i, j = _piece(a, u), _piece(b, v)
    pick = lambda values, at: F.get(F.array(*[F.lit(float(w)) for w in np.ravel(values)]), at)
    dx, t = a - pick(u, i), (b - pick(v, j)) / pick(np.diff(v), j)
    out, at = F.lit(0.0), i * F.lit(len(v)) + j
    for c in cells[::-1]:
        near = pick(c, at)
        out = out * dx + near + (pick(c, at + 1) - near) * t
    return F.when(a.isNotNull() & b.isNotNull(), out)


def bspline(x, knots: Sequence[float], coefficients: Sequence[float], degree: int = 3) -> Column:
    """A B-spline by its knots and coefficients, as polynomial pieces between distinct knots; held at its ends."""
    t, c, k = np.asarray(knots, float), np.asarray(coefficients, float), degree
    spans = [j for j in range(k, len(t) - k - 1) if t[j + 1] > t[j]]
    xs = [t[spans[0]], *[t[j + 1] for j in spans]]
    z0 = clip(x, xs[0], xs[-1])
    pieces = []
    for j in spans:
        at = t[j] + (t[j + 1] - t[j]) * np.linspace(0, 1, k + 1)
        poly = np.polyfit(at - t[j], [de_boor(v, j, t, c, k) for v in at], k)[::-1]
        z = z0 - F.lit(float(t[j]))
        pieces.append(functools.reduce(lambda acc, a, z=z: acc * z + F.lit(float(a)), poly[::-1], F.lit(0.0)))
    return _segments(z0, xs, pieces, pieces[0], pieces[-1])


def de_boor(x: float, j: int, t: np.ndarray, c: np.ndarray, k: int) -> float:
    d = [float(c[i + j - k]) for i in range(k + 1)]
    for r in range(1, k + 1):
        for i in range(k, r - 1, -1):
            width = t[i + 1 + j - r] - t[i + j - k]
            a = (x - t[i + j - k]) / width if width else 0.0
            d[i] = (1 - a) * d[i - 1] + a * d[i]
    return d[k]


def bspline_basis(x, knots: Sequence[float], degree: int = 3) -> list[Column]:
    """One column per basis function."""
    n = len(knots) - degree - 1
    return [bspline(x, knots, np.eye(n)[i], degree) for i in range(n)]


def hinge(x, low: float, high: float, level: float, slope: float, knots: Sequence[float], weights: Sequence[float]) -> Column:
    """level + slope * z + sum of weights * max(z - knot, 0), z being x scaled to 0..1 and held there."""
    z = (clip(x, low, high) - F.lit(float(low))) / F.lit(float(high - low))
    bends = [F.lit(float(w)) * F.greatest(z - F.lit(float(t)), F.lit(0.0)) for t, w in zip(knots, weights, strict=True)]
    return functools.reduce(operator.add, bends, F.lit(float(level)) + F.lit(float(slope)) * z)


def flat_ramps(x, knots: Sequence[float], bias: bool = False, dummies: Sequence[int] = ()) -> list[Column]:
    """One clip per interval of the knots, less its lower end where there is one; optional constant and 0/1 columns of
    segments, whose ends belong to both neighbours."""
    x = col(x).cast("double")
    ends = [None, *map(float, knots), None]
    out = [F.lit(1.0)] if bias else []
    out += [clip(x, a, b) - F.lit(a if a is not None else 0.0) if a is not None else clip(x, None, b) for a, b in zip(ends, ends[1:], strict=False)]
    n = len(ends) - 1
    for i in dummies:
        a, b = ends[i % n], ends[i % n + 1]
        inside = (x >= a if a is not None else F.lit(True)) & (x <= b if b is not None else F.lit(True))
        out.append(F.when(x.isNotNull(), inside.cast("double")))
    return out


def bump(x, low: float, high: float, width: float, height: float = 1.0) -> Column:
    x = col(x)
    return F.lit(height) * logistic((x - low) / width) * logistic((high - x) / width)


def gate(x, at: float, width: float, rising: bool = True) -> Column:
    z = (col(x) - at) / width
    return logistic(z if rising else -z)


def standardized(x, mean: float, scale: float) -> Column:
    return (col(x) - F.lit(float(mean))) / F.lit(float(scale))


def logit(p) -> Column:
    p = col(p)
    return F.log(p / (1 - p))


def cloglog(p) -> Column:
    return F.log(-F.log(1 - col(p)))


def prior_corrected(p, weight: float) -> Column:
    """A score learnt with non-events sampled at the rate weight, back on the full population."""
    p = col(p)
    return p * F.lit(weight) / (p * F.lit(weight) + 1 - p)


def cpr(smm) -> Column:
    return 1 - F.pow(1 - col(smm), F.lit(12.0))


def annualized(monthly) -> Column:
    return col(monthly) * 12
