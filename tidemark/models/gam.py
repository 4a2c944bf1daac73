"""Additive models: penalised spline fits by distributed sums, partial-dependence curves, and replay from curves alone."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import curves
from .linear import gram


@dataclass
class Term:
    """kind: spline (x, y), by (feature, by, groups: level -> curve), tensor (x, y, z) or factor (levels -> value); errors:
    standard errors in the order of effects()."""

    kind: str
    feature: str
    x: list[float] = field(default_factory=list)
    y: list[float] = field(default_factory=list)
    by: str | None = None
    groups: dict[str, dict[str, list[float]]] = field(default_factory=dict)
    other: str | None = None
    z: list[list[float]] = field(default_factory=list)
    levels: dict[str, float] = field(default_factory=dict)
    errors: list[float] = field(default_factory=list)

    def effects(self) -> list[tuple]:
        """(level, x, other, effect) at every point of the term."""
        if self.kind == "factor":
            return [(k, None, None, v) for k, v in self.levels.items()]
        if self.kind == "by":
            return [(k, x, None, y) for k, c in self.groups.items() for x, y in zip(c["x"], c["y"], strict=True)]
        if self.kind == "tensor":
            return [(None, x, y, v) for x, row in zip(self.x, self.z, strict=True) for y, v in zip(self.y, row, strict=True)]
        return [(None, x, None, y) for x, y in zip(self.x, self.y, strict=True)]

    @property
    def name(self) -> str:
        mark = {"spline": "s", "by": "s", "tensor": "te", "factor": "f"}[self.kind]
        return "__".join([mark, self.feature, *([self.other] if self.other else []), *(["by", self.by] if self.by else [])])

    def column(self) -> Column:
        if self.kind == "spline":
            return curves.pchip(self.feature, self.x, self.y)
        if self.kind == "factor":
            out = F.lit(0.0)
            for level, v in self.levels.items():
                out = F.when(F.col(self.feature).cast("string") == F.lit(level), F.lit(float(v))).otherwise(out)
            return out
        if self.kind == "by":
            out = F.lit(0.0)
            for level, c in self.groups.items():
                out = F.when(F.col(self.by).cast("string") == F.lit(level), curves.pchip(self.feature, c["x"], c["y"])).otherwise(out)
            return out
        return curves.surface(self.feature, self.other, self.x, self.y, self.z)


@dataclass
class Replay:
    """Scores from exported curves only."""

    terms: list[Term]
    intercept: float = 0.0

    def decompose(self, df: DataFrame) -> DataFrame:
        """One column per term, intercept and pred."""
        df = df.withColumns({t.name: t.column() for t in self.terms}).withColumn("intercept", F.lit(float(self.intercept)))
        total = F.col("intercept")
        for t in self.terms:
            total = total + F.col(t.name)
        return df.withColumn("pred", total)

    def column(self) -> Column:
        out = F.lit(float(self.intercept))
        for t in self.terms:
            out = out + t.column()
        return out

    def centered(self) -> Replay:
        """Curves of mean 0: offsets of plain terms go to the intercept, those of by-curves to a factor term."""
        shift, terms, factors = 0.0, [], {}
        for t in self.terms:
            t = Term(**json.loads(json.dumps(asdict(t))))
            if t.kind == "spline":
                m = float(np.mean(t.y))
                t.y, shift = [v - m for v in t.y], shift + m
            elif t.kind == "tensor":
                m = float(np.mean(t.z))
                t.z, shift = [[v - m for v in row] for row in t.z], shift + m
            elif t.kind == "by":
                own = factors.setdefault(t.by, {})
                for level, c in t.groups.items():
                    m = float(np.mean(c["y"]))
                    c["y"] = [v - m for v in c["y"]]
                    own[level] = own.get(level, 0.0) + m
            terms.append(t)
        for by, own in factors.items():
            have = next((t for t in terms if t.kind == "factor" and t.feature == by), None)
            if have is None:
                terms.append(have := Term("factor", by))
            for level, m in own.items():
                have.levels[level] = have.levels.get(level, 0.0) + m
        return Replay(terms, self.intercept + shift)

    def partial_dependence(self, spark: SparkSession, width: float = 0.95) -> DataFrame:
        """(term, level, x, other, effect, low, high) at every point of every term; the interval is null without errors."""
        z = NormalDist().inv_cdf((1 + width) / 2)
        rows = []
        for t in self.terms:
            points = t.effects()
            spans = [z * e for e in t.errors] or [None] * len(points)
            for (level, x, other, v), s in zip(points, spans, strict=True):
                rows.append((t.name, level, x, other, float(v), *((None, None) if s is None else (float(v - s), float(v + s)))))
        return spark.createDataFrame(rows, "term string, level string, x double, other double, effect double, low double, high double")

    @staticmethod
    def from_components(text: str) -> Replay:
        """A replay of exported smooth components: smooths (label -> x, fit, se, var, by_var, by_level, the last three as one
        value or a list), parametric (term, Estimate, Std. Error) and xlevels (factor -> levels); a level without an
        estimate is the base level, 0."""
        got, terms = json.loads(text), []
        one = lambda v: v[0] if isinstance(v, list) and v else None if isinstance(v, list) else v
        for s in (got.get("smooths") or {}).values():
            var, by = one(s["var"]), one(s.get("by_var"))
            errors = list(s.get("se") or [0.0] * len(s["x"]))
            if by is None or by != by:
                terms.append(Term("spline", var, list(s["x"]), list(s["fit"]), errors=errors))
                continue
            t = next((t for t in terms if t.kind == "by" and (t.feature, t.by) == (var, by)), None)
            if t is None:
                terms.append(t := Term("by", var, by=by))
            t.groups[str(one(s["by_level"]))] = {"x": list(s["x"]), "y": list(s["fit"])}
            t.errors += errors
        p = got.get("parametric") or {}
        names = p.get("term", [])
        estimates = dict(zip(names, zip(p.get("Estimate", []), p.get("Std. Error") or [0.0] * len(names), strict=True), strict=True))
        for factor, levels in (got.get("xlevels") or {}).items():
            found = {str(v): estimates.get(f"{factor}{v}", (0.0, 0.0)) for v in levels}
            if found:
                terms.append(Term("factor", factor, levels={k: v for k, (v, _) in found.items()}, errors=[e for _, e in found.values()]))
        return Replay(terms, float(one(got.get("intercept", 0.0)) or 0.0))

    def to_json(self) -> str:
        return json.dumps({"intercept": self.intercept, "terms": [asdict(t) for t in self.terms]})

    @staticmethod
    def from_json(text: str) -> Replay:
        got = json.loads(text)
        return Replay([Term(**t) for t in got["terms"]], got["intercept"])


@dataclass
class Spline:
    """A smooth term to fit: interior knots at even places between low and high; by fits one curve per level."""

    feature: str
    low: float
    high: float
    knots: int = 8
    smooth: float = 1.0
    by: str | None = None
    levels: Sequence[str] = ()

    def basis(self) -> tuple[list[Column], list[float]]:
        inner = np.linspace(self.low, self.high, self.knots)
        t = [self.low] * 3 + inner.tolist() + [self.high] * 3
        return curves.bspline_basis(self.feature, t), t


@dataclass
class Tensor:
    """A surface over two features to fit: products of two spline bases, smooth along both."""

    feature: str
    low: float
    high: float
    other: str
    other_low: float
    other_high: float
    knots: int = 4
    smooth: float = 1.0

    def sides(self) -> tuple[Spline, Spline]:
        return Spline(self.feature, self.low, self.high, self.knots), Spline(self.other, self.other_low, self.other_high, self.knots)


@dataclass
class Factor:
    feature: str
    levels: Sequence[str]
    smooth: float = 1e-6


def fit(df: DataFrame, y: str, terms: Sequence[Spline | Tensor | Factor], weight: str | None = None, points: int = 50) -> Replay:
    """Penalised least squares: one aggregate for the normal equations, second differences as the penalty. The result is
    its own partial dependence: every smooth as a curve on an even grid, centred over the grid, with the standard errors of
    the centred curve (residual variance times the inverse of the penalised sums)."""
    columns: list[Column] = [F.lit(1.0)]
    spans: list[tuple] = []
    for t in terms:
        if isinstance(t, Factor):
            cols = [(F.col(t.feature).cast("string") == F.lit(v)).cast("double") for v in t.levels]
            spans.append((t, None, len(columns), len(cols), None))
            columns += cols
        elif isinstance(t, Tensor):
            (a, s), (b, u) = (side.basis() for side in t.sides())
            spans.append((t, None, len(columns), len(a) * len(b), (s, u)))
            columns += [x * z for x in a for z in b]
        else:
            basis, knots = t.basis()
            for level in t.levels if t.by else [None]:
                inside = F.lit(1.0) if level is None else (F.col(t.by).cast("string") == F.lit(level)).cast("double")
                spans.append((t, level, len(columns), len(basis), knots))
                columns += [b * inside for b in basis]
    g, n = gram(df, [*columns, F.col(y)], F.col(weight) if weight else None)
    p = len(columns)
    penalty = 1e-8 * n * np.eye(p)
    penalty[0, 0] = 0
    bent = lambda k: (lambda d: d.T @ d)(np.diff(np.eye(k), n=2, axis=0))
    for t, _, at, k, knots in spans:
        if isinstance(t, Spline):
            penalty[at : at + k, at : at + k] += t.smooth * bent(k)
        elif isinstance(t, Tensor):
            m, l = (len(x) - 4 for x in knots)
            penalty[at : at + k, at : at + k] += t.smooth * (np.kron(bent(m), np.eye(l)) + np.kron(np.eye(m), bent(l)))
        else:
            penalty[at : at + k, at : at + k] += t.smooth * n * np.eye(k)
    inverse = np.linalg.inv(g[:p, :p] + penalty)
    b = np.linalg.solve(g[:p, :p] + penalty, g[:p, p])
    rss = max(0.0, g[p, p] - 2 * b @ g[:p, p] + b @ g[:p, :p] @ b)
    variance = rss / max(1.0, n - float(np.trace(inverse @ g[:p, :p])))

    def errors(rows: np.ndarray, at: int) -> list[float]:
        r, k = rows - rows.mean(axis=0), rows.shape[1]
        return np.sqrt(np.maximum(0.0, variance * np.einsum("ij,jk,ik->i", r, inverse[at : at + k, at : at + k], r))).tolist()

    out: dict[tuple, Term] = {}
    for t, level, at, k, knots in spans:
        if isinstance(t, Factor):
            out[(t.feature, None)] = Term("factor", t.feature, levels={v: float(c) for v, c in zip(t.levels, b[at : at + k], strict=True)}, errors=errors(np.eye(k), at))
            continue
        if isinstance(t, Tensor):
            grids = [np.linspace(s.low, s.high, max(8, points // 4)) for s in t.sides()]
            m, l = (basis_matrix(x, s) for x, s in zip(grids, knots, strict=True))
            z = m @ b[at : at + k].reshape(m.shape[1], l.shape[1]) @ l.T
            out[(t.feature, t.other)] = Term("tensor", t.feature, grids[0].tolist(), grids[1].tolist(), other=t.other, z=z.tolist(), errors=errors(np.kron(m, l), at))
            continue
        xs = np.linspace(t.low, t.high, points)
        ys = evaluate(xs, knots, b[at : at + k])
        if level is None:
            out[(t.feature, None, "s")] = Term("spline", t.feature, xs.tolist(), ys.tolist(), errors=errors(basis_matrix(xs, knots), at))
        else:
            term = out.setdefault((t.feature, t.by, "by"), Term("by", t.feature, by=t.by))
            term.groups[level] = {"x": xs.tolist(), "y": ys.tolist()}
            term.errors += errors(basis_matrix(xs, knots), at)
    return Replay(list(out.values()), float(b[0])).centered()


def basis_matrix(xs: np.ndarray, knots: Sequence[float]) -> np.ndarray:
    """One column per basis function at every x."""
    return np.column_stack([evaluate(xs, knots, e) for e in np.eye(len(knots) - 4)])


def evaluate(xs: np.ndarray, knots: Sequence[float], coefficients: np.ndarray, degree: int = 3) -> np.ndarray:
    t = np.asarray(knots, float)
    spans = [j for j in range(degree, len(t) - degree - 1) if t[j + 1] > t[j]]
    out = []
    for x in xs:
        j = next((s for s in spans if x <= t[s + 1]), spans[-1])
        out.append(curves.de_boor(float(x), j, t, coefficients, degree))
    return np.array(out)
