"""Product-form models: prediction = scalar * product of blocks, each block linear in its own basis columns.

Basis columns are column expressions, so a fit never widens the table: each block step is one aggregate of p (p + 1) / 2
+ p sums over a persisted projection, and a prediction is a column.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import curves
from .linear import gram, grams, solve

RIDGE = 1e-8


@dataclass
class Block:
    """A named group of basis columns; by: a category column with coefficients of its own per category."""

    name: str
    basis: Callable[[], list[Column]]
    by: str | None = None

    @staticmethod
    def ramps(name: str, column: str, knots: Sequence[float], by: str | None = None) -> Block:
        return Block(name, lambda: curves.flat_ramps(column, knots, bias=True), by)

    @staticmethod
    def categories(name: str, column: str, levels: Sequence) -> Block:
        return Block(name, lambda: [(F.col(column) == F.lit(v)).cast("double") for v in levels])


@dataclass
class ProductModel:
    blocks: list[Block]
    loss: str = "mse"
    fixed: dict[str, Column] = field(default_factory=dict)
    offset: str | None = None
    scalar: float = 1.0
    coefficients: dict[str, dict] = field(default_factory=dict)
    history: list[float] = field(default_factory=list)

    def block_column(self, block: Block) -> Column:
        out = F.lit(None).cast("double")
        basis = block.basis()
        for level, b in self.coefficients[block.name].items():
            value = F.lit(0.0)
            for c, x in zip(b, basis, strict=True):
                value = value + F.lit(float(c)) * x
            out = value if level is None else F.when(F.col(block.by) == F.lit(level), value).otherwise(out)
        return out if block.by is None else F.coalesce(out, F.lit(1.0))

    def column(self, without: str | None = None) -> Column:
        """The prediction, or the product of all other blocks."""
        out = F.lit(self.scalar)
        for b in self.blocks:
            if b.name != without:
                out = out * self.block_column(b)
        for name, c in self.fixed.items():
            if name != without:
                out = out * c
        return out * F.col(self.offset) if self.offset else out

    def fit(self, df: DataFrame, y: str, weight: str | None = None, rounds: int = 30, force: int = 5, ftol: float = 1e-9) -> ProductModel:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return self._fit(df, y, weight, rounds, force, ftol)
        finally:
            df.unpersist()

    def _fit(self, df: DataFrame, y: str, weight: str | None, rounds: int, force: int, ftol: float) -> ProductModel:
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        self.scalar = float(df.agg(F.sum(w * F.col(y)) / F.sum(w)).first()[0])
        for b in self.blocks:
            self.coefficients[b.name] = self._ones(df, b)
        best, kept = np.inf, None
        for i in range(rounds):
            for b in self.blocks:
                self._step(df, b, y, w)
            now = float(df.agg(self._loss(y, w)).first()[0])
            self.history.append(now)
            if now < best:
                best, kept = now, (self.scalar, {k: dict(v) for k, v in self.coefficients.items()})
            if i >= force and self.history[-6] - now <= ftol * max(1.0, abs(now)):
                break
        if kept:
            self.scalar, self.coefficients = kept
        return self

    def fit_jointly(self, df: DataFrame, y: str, weight: str | None = None, rounds: int = 30, ftol: float = 1e-10) -> ProductModel:
        """All coefficients at once by damped Gauss-Newton steps on the squared error, from the present coefficients or one
        block round. A step is one aggregate of the products of the Jacobian's columns, which are block columns times the
        other blocks; blocks with categories of their own aren't taken."""
        if self.loss != "mse" or any(b.by for b in self.blocks):
            raise ValueError("only squared error and blocks without categories")
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if not self.coefficients:
                self._fit(df, y, weight, 1, 5, ftol)
            w = F.col(weight).cast("double") if weight else F.lit(1.0)
            best, damping = float(df.agg(self._loss(y, w)).first()[0]), 1e-3
            for _ in range(rounds):
                jacobian = [x * self.column(without=b.name) for b in self.blocks for x in b.basis()]
                g, _n = gram(df, [*jacobian, F.col(y) - self.column()], w)
                p, kept = len(jacobian), dict(self.coefficients)
                step = solve(g[:p, :p] + np.diag(damping * np.diag(g)[:p] + RIDGE), g[:p, p])
                for b in self.blocks:
                    size = len(kept[b.name][None])
                    self.coefficients[b.name] = {None: kept[b.name][None] + step[:size]}
                    step = step[size:]
                now = float(df.agg(self._loss(y, w)).first()[0])
                self.history.append(now)
                if now >= best:
                    self.coefficients, damping = kept, damping * 10
                    if damping > 1e6:
                        break
                    continue
                done, best, damping = best - now <= ftol * max(1.0, best), now, damping / 5
                if done:
                    break
        finally:
            df.unpersist()
        return self

    def groups(self) -> dict[str, list[str]]:
        """Names of each block's design columns."""
        return {b.name: [f"{b.name}_{i}" for i in range(len(b.basis()))] for b in self.blocks}

    def expanded(self, df: DataFrame) -> DataFrame:
        """df with all design columns."""
        return df.withColumns({n: x for b, names in zip(self.blocks, self.groups().values(), strict=True) for n, x in zip(names, b.basis(), strict=True)})

    def feature_curve(self, grid: DataFrame, name: str, out: str = "effect") -> DataFrame:
        """grid, which holds the block's columns, with the block's factor at each of its rows."""
        return grid.withColumn(out, self.block_column(next(b for b in self.blocks if b.name == name)))

    @staticmethod
    def _sums(df: DataFrame, b: Block, columns: list[Column], w: Column | None = None) -> dict:
        """(sums of products, rows) by level, in one pass; the level of a block without categories is null."""
        return {None: gram(df, columns, w)} if b.by is None else grams(df, b.by, columns, w)

    def _ones(self, df: DataFrame, b: Block) -> dict:
        """By level, coefficients whose block is nearest to 1."""
        basis = b.basis()
        p = len(basis)
        sums = self._sums(df, b, [*basis, F.lit(1.0)])
        return {v: solve(sums[v][0][:p, :p], sums[v][0][:p, p], RIDGE) for v in sorted(sums, key=str)}

    def _loss(self, y: str, w: Column) -> Column:
        p = self.column()
        if self.loss == "poisson":
            p = F.greatest(p, F.lit(1e-10))
            each = 2 * (F.when(F.col(y) > 0, F.col(y) * F.log(F.col(y) / p)).otherwise(F.lit(0.0)) - (F.col(y) - p))
        else:
            each = (F.col(y) - p) ** 2
        return F.sum(w * each) / F.sum(w)

    def _step(self, df: DataFrame, b: Block, y: str, w: Column) -> None:
        others = self.column(without=b.name)
        if self.loss == "poisson":
            w = w / F.greatest(self.column(), F.lit(1e-10))
        basis = b.basis()
        p = len(basis)
        for level, (g, n) in self._sums(df, b, [*[x * others for x in basis], F.col(y)], w).items():
            if n and level in self.coefficients[b.name]:
                self.coefficients[b.name][level] = solve(g[:p, :p], g[:p, p], RIDGE * max(1.0, float(np.trace(g[:p, :p])) / p))
        if b.by is None:
            mean = float(df.agg(F.avg(self.block_column(b))).first()[0])
            if abs(mean) > 1e-12:
                self.coefficients[b.name] = {v: c / mean for v, c in self.coefficients[b.name].items()}
                self.scalar *= mean
        else:
            means = {r[0]: r[1] for r in df.groupBy(b.by).agg(F.avg(self.block_column(b))).collect()}  # one row a category
            total = np.mean([m for v, m in means.items() if v is not None]) or 1.0
            self.coefficients[b.name] = {v: c / total for v, c in self.coefficients[b.name].items()}
            self.scalar *= float(total)

    def errors(self, df: DataFrame, y: str) -> dict[str, dict]:
        """Standard errors of each block's coefficients with the other blocks held."""
        out: dict[str, dict] = {}
        for b in self.blocks:
            basis, others = b.basis(), self.column(without=b.name)
            p, out[b.name] = len(basis), {}
            for level, c in self.coefficients[b.name].items():
                part = df if level is None else df.where(F.col(b.by) == F.lit(level))
                g, n = gram(part, [*[x * others for x in basis], F.col(y)])
                rss = g[p, p] - 2 * c @ g[:p, p] + c @ g[:p, :p] @ c
                out[b.name][level] = np.sqrt(np.maximum(0, np.diag(np.linalg.pinv(g[:p, :p])) * rss / max(1, n - p)))
        return out

    def summary(self, df: DataFrame, y: str) -> list[tuple]:
        """(block, level, index, coefficient, low, high) at 1.96 standard errors."""
        se = self.errors(df, y)
        return [(n, v, i, float(c), float(c - 1.96 * s), float(c + 1.96 * s)) for n, levels in self.coefficients.items() for v, cs in levels.items() for i, (c, s) in enumerate(zip(cs, se[n][v], strict=True))]

    def to_json(self) -> str:
        return json.dumps({"scalar": self.scalar, "loss": self.loss, "coefficients": {n: [[v, list(map(float, c))] for v, c in levels.items()] for n, levels in self.coefficients.items()}})

    def load(self, text: str) -> ProductModel:
        got = json.loads(text)
        self.scalar, self.loss = got["scalar"], got["loss"]
        self.coefficients = {n: {v: np.array(c) for v, c in levels} for n, levels in got["coefficients"].items()}
        return self


@dataclass
class ProductClassifier:
    """Product-form probability, held in [eps, 1 - eps]: each block by damped Newton steps on the cross entropy."""

    model: ProductModel
    eps: float = 1e-6

    def column(self) -> Column:
        return F.least(F.greatest(self.model.column(), F.lit(self.eps)), F.lit(1 - self.eps))

    def fit(self, df: DataFrame, y: str, rounds: int = 15) -> ProductClassifier:
        # Iteratively weighted least squares: the variance of a 0/1 response is p (1 - p).
        self.model.fit(df, y, None, rounds=5)
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        for _ in range(rounds):
            p = self.column()
            for b in self.model.blocks:
                self.model._step(df, b, y, 1 / (p * (1 - p)))
        df.unpersist()
        return self

    def fit_joint(self, df: DataFrame, y: str, rounds: int = 50, ridge: float = 1e-6) -> ProductClassifier:
        """All blocks at once: quasi-Newton on the cross entropy, each value and gradient one distributed aggregate."""
        from .fits import lbfgs

        self.model.fit(df, y, None, rounds=3)
        slots = [(b, v, len(c)) for b in self.model.blocks for v, c in self.model.coefficients[b.name].items()]
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        n = df.count()

        def put(x: np.ndarray) -> None:
            at = 0
            for b, v, k in slots:
                self.model.coefficients[b.name][v] = x[at : at + k]
                at += k

        def value(x: np.ndarray) -> tuple[float, np.ndarray]:
            put(x)
            p, t = self.column(), F.col(y).cast("double")
            raw = self.model.column()
            inside = ((raw > self.eps) & (raw < 1 - self.eps)).cast("double")
            slope = inside * (p - t) / (p * (1 - p))
            sums = [F.sum(-(t * F.log(p) + (1 - t) * F.log(1 - p)))]
            for b, v, _ in slots:
                here = slope * self.model.column(without=b.name)
                here = here if v is None else F.when(F.col(b.by) == F.lit(v), here).otherwise(F.lit(0.0))
                sums += [F.sum(here * c) for c in b.basis()]
            row = df.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
            return row[0] / n + ridge * float(x @ x), np.array(row[1:], dtype=float) / n + 2 * ridge * x

        put(lbfgs(value, np.concatenate([self.model.coefficients[b.name][v] for b, v, _ in slots]), rounds))
        df.unpersist()
        return self
