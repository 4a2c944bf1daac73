"""A layered spread model: rows are tagged, a structural curve is fitted, keyed memory takes the residuals, and daily
kernel curves take what is left. update() goes on from stored state."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import curves
from ..operators import filters, joins, smoothing
from .fits import fit_hinge, hinge_terms, solve_hinge
from .linear import grams


@dataclass
class Config:
    """Column roles and sizes."""

    target: str
    key: str
    day: str
    x: str
    bucket: str
    low: float
    high: float
    knots: Sequence[float] = (0.25, 0.5, 0.75)
    monotone: int = -1
    components: dict[str, tuple[float, float]] = field(default_factory=dict)
    alpha: float = 0.3
    shrink: float = 3.0
    life: float = 30.0
    width: float = 0.15
    grid: int = 11
    blend: float = 0.7
    bucket_shrink: float | None = None  # rows at which a bucket's own curve has half its weight; None: biases only
    filters: Sequence = ()
    clips: Sequence[filters.Clip] = ()


@dataclass
class LayeredModel:
    config: Config
    base: dict | None = None
    parts: dict[str, dict] = field(default_factory=dict)
    bias: dict[str, float] = field(default_factory=dict)
    shapes: dict[str, dict] = field(default_factory=dict)

    # --- layer 1: structure -------------------------------------------------------------------------------------------

    def structural(self) -> Column:
        """Base curve, additive components, the bucket's own curve and its bias."""
        c = self.config
        out = _hinge(c.x, self.base)
        for name, h in self.parts.items():
            out = out + _hinge(name, h)
        shape = F.lit(0.0)
        for b, h in self.shapes.items():
            shape = F.when(F.col(c.bucket).cast("string") == F.lit(b), _hinge(c.x, h)).otherwise(shape)
        bias = F.lit(0.0)
        for b, v in self.bias.items():
            bias = F.when(F.col(c.bucket).cast("string") == F.lit(b), F.lit(v)).otherwise(bias)
        return out + shape + bias

    def _grid(self) -> list[float]:
        return np.linspace(self.config.low, self.config.high, self.config.grid).tolist()

    def _rows(self, df: DataFrame) -> DataFrame:
        return filters.apply_clips(filters.tag_rows(df, self.config.filters), self.config.clips)

    def fit(self, df: DataFrame) -> LayeredModel:
        """Base curve first, components on its residuals, bucket curves and then bucket means on theirs; components are centred."""
        c = self.config
        self.config.clips = filters.learn_clips(df, c.clips)
        rows = self._rows(df).where("_scorable")
        self.base = fit_hinge(rows, c.x, c.target, c.low, c.high, c.knots, monotone=c.monotone)
        left = rows.withColumn("__left", F.col(c.target) - _hinge(c.x, self.base))
        for name, (low, high) in c.components.items():
            h = fit_hinge(left, name, "__left", low, high, (0.5,))
            mean = left.agg(F.avg(_hinge(name, h))).first()[0]
            self.base["level"] += mean
            h["level"] -= mean
            self.parts[name] = h
            left = left.withColumn("__left", F.col(c.target) - _hinge(c.x, self.base) - sum((_hinge(n, p) for n, p in self.parts.items()), F.lit(0.0)))
        if c.bucket_shrink is not None:
            self.shapes = self._bucket_curves(rows)
            self.bias = {}
            left = rows.withColumn("__left", F.col(c.target) - self.structural())
        self.bias = {str(r[0]): float(r[1]) for r in left.groupBy(F.col(c.bucket).cast("string")).agg(F.avg("__left")).collect() if r[0] is not None}  # one row a bucket
        return self

    def _bucket_curves(self, rows: DataFrame) -> dict[str, dict]:
        """What each bucket's curve adds to the base curve, from one aggregate. A bucket's whole curve is fitted under the
        base's monotonicity and mixed with the base by its rows, so that base plus shape is monotone as well."""
        c, knots = self.config, self.base["knots"]
        rest = F.col(c.target) - sum((_hinge(n, p) for n, p in self.parts.items()), F.lit(0.0))
        by = grams(rows.withColumn("__bucket", F.col(c.bucket).cast("string")), "__bucket", [*hinge_terms(c.x, c.low, c.high, knots), rest])
        out = {}
        for b, (g, n) in by.items():
            own, part = solve_hinge(g, n, c.low, c.high, knots, monotone=c.monotone), n / (n + c.bucket_shrink)
            mixed = {k: part * (own[k] - self.base[k]) for k in ("level", "slope")}
            mixed["weights"] = [part * (v - w) for v, w in zip(own["weights"], self.base["weights"], strict=True)]
            out[b] = {"low": c.low, "high": c.high, "knots": list(knots)} | mixed
        return out

    # --- layers 2 and 3 -----------------------------------------------------------------------------------------------

    def layers(self, df: DataFrame, since=None) -> tuple[DataFrame, DataFrame]:
        """(memory rows, daily curves) of the scorable rows, from scratch; the structure stays as fitted. Days before since
        are left out, and with them what the memory had learnt there."""
        c = self.config
        df = df if since is None else df.where(F.col(c.day) >= F.lit(since))
        rows = self._rows(df).where("_scorable").withColumn("residual", F.col(c.target) - self.structural())
        memory = smoothing.keyed_memory(rows.select(c.key, c.day, c.x, c.bucket, "residual"), "residual", c.day, [c.key], [c.x], c.alpha, c.shrink, c.life)
        left = memory.withColumn("left", F.col("residual") - F.col("adjustment"))
        return memory, smoothing.daily_curves(left, c.day, c.bucket, c.x, "left", self._grid(), c.width, c.blend)

    def update(self, df: DataFrame, memory: DataFrame, daily: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(memory rows, daily curves) of new days only, going on from earlier ones; the structure stays as fitted."""
        c = self.config
        rows = self._rows(df).where("_scorable").withColumn("residual", F.col(c.target) - self.structural())
        state = smoothing.memory_state(memory, c.day, [c.key], [c.x])
        new = smoothing.resume_memory(rows.select(c.key, c.day, c.x, c.bucket, "residual"), state, "residual", c.day, c.key, [c.x], c.alpha, c.shrink, c.life)
        left = new.withColumn("left", F.col("residual") - F.col("adjustment"))
        return new, smoothing.daily_curves(left, c.day, c.bucket, c.x, "left", self._grid(), c.width, c.blend, start=daily)

    def predict(self, df: DataFrame, memory: DataFrame, daily: DataFrame) -> DataFrame:
        """df with structural, adjustment, delta and prediction; rows that can't be scored keep their reason and nulls."""
        c = self.config
        rows = self._rows(df).withColumn("structural", F.when(F.col("_scorable"), self.structural()))
        state = memory.groupBy(c.key, c.day).agg(F.max_by(F.struct("ema", "n"), F.col("n")).alias("s")).select(c.key, F.col(c.day).alias("__d"), F.col("s.ema").alias("ema"), F.col("s.n").alias("n"))
        # Yesterday's state, decayed: strictly before the row's day, so that nothing is seen ahead.
        moved = state.withColumn("__d", F.date_add(F.to_date("__d"), 1))
        found = joins.as_of(rows.withColumn("__day", F.to_date(c.day)), moved, [c.key], "__day", "__d", ["ema", "n"])
        keep = F.exp(-F.lit(float(np.log(2) / c.life)) * F.greatest(F.datediff("__day", "as_of_time") + 1, F.lit(0)).cast("double"))
        n = F.col("n") * keep
        found = found.withColumn("adjustment", F.when(F.col("_scorable"), F.coalesce(n / (n + c.shrink) * F.col("ema") * keep, F.lit(0.0))))
        curve = daily.select(c.bucket, F.to_date(c.day).alias("__cd"), "curve")
        found = joins.as_of(found.drop("as_of_time", "ema", "n"), curve, [c.bucket], "__day", "__cd", ["curve"])
        delta = smoothing.curve_value("curve", c.x, c.low, c.high, c.grid)
        found = found.withColumn("delta", F.when(F.col("_scorable"), F.coalesce(delta, F.lit(0.0))))
        return found.withColumn("prediction", F.col("structural") + F.col("adjustment") + F.col("delta")).drop("__day", "as_of_time", "curve")

    def report(self, df: DataFrame, memory: DataFrame, daily: DataFrame) -> DataFrame:
        """df with every layer's share (adj_), the prediction up to it (pred_) and, where the target is known, what is left
        (resid_): structural, bond and delta or final. Rows that can't be scored keep their reason and nulls."""
        out = self.predict(df, memory, daily)
        shares = dict(zip(("structural", "bond", "delta"), ("structural", "adjustment", "delta"), strict=True))
        out = out.withColumns({f"adj_{k}": F.col(v) for k, v in shares.items()})
        preds = {"structural": F.col("structural"), "bond": F.col("structural") + F.col("adjustment"), "final": F.col("prediction")}
        out = out.withColumns({f"pred_{k}": v for k, v in preds.items()})
        if self.config.target in df.columns:
            out = out.withColumns({f"resid_{k}": F.col(self.config.target) - F.col(f"pred_{k}") for k in preds})
        return out.drop("structural", "adjustment", "delta", "prediction")

    def to_json(self) -> str:
        plain = asdict(self.config) | {"filters": [list(f) if not isinstance(f, filters.Criteria) else list(f.as_tuple) for f in self.config.filters]}
        return json.dumps({"config": plain, "base": self.base, "parts": self.parts, "bias": self.bias, "shapes": self.shapes})

    @staticmethod
    def from_json(text: str) -> LayeredModel:
        got = json.loads(text)
        cfg = got["config"]
        cfg["clips"] = [filters.Clip(**x) for x in cfg["clips"]]
        cfg["filters"] = [tuple(f) for f in cfg["filters"]]
        cfg["components"] = {k: tuple(v) for k, v in cfg["components"].items()}
        return LayeredModel(Config(**cfg), got["base"], got["parts"], got["bias"], got.get("shapes", {}))


def _hinge(x: str, h: dict) -> Column:
    return curves.hinge(x, h["low"], h["high"], h["level"], h["slope"], h["knots"], h["weights"])


def basis_delta(x: Column, low: float, high: float) -> list[Column]:
    """Shift, tilt and two bends on x scaled to -1..1."""
    z = (x - F.lit(float(low))) / F.lit(float(high - low)) * 2 - 1
    return [F.lit(1.0), z, z * z - F.lit(1 / 3), z * z * z - z * F.lit(0.6)]


def gaussian_basis(x: Column, centers: Sequence[float], width: float) -> list[Column]:
    return [F.exp(-(((x - F.lit(float(m))) / F.lit(float(width))) ** 2) / 2) for m in centers]


def fit_basis(df: DataFrame, y: str, basis: Sequence[Column], ridge: float, day: str, smooth: float = 0.0) -> dict:
    """Coefficients per day by ridge least squares with squared day-to-day steps: one aggregate keyed by day, one
    block-banded solve over the calendar, linear in its days."""
    p = len(basis)
    named = df.select(F.col(day).alias("d"), F.col(y).cast("double").alias("y"), *[b.alias(f"b{i}") for i, b in enumerate(basis)]).dropna()
    sums = [F.sum(F.col(f"b{i}") * F.col(f"b{j}")).alias(f"g{i}_{j}") for i in range(p) for j in range(i, p)] + [F.sum(F.col(f"b{i}") * F.col("y")).alias(f"c{i}") for i in range(p)]
    rows = sorted(named.groupBy("d").agg(*sums).collect(), key=lambda r: r["d"])  # one row a day
    t = len(rows)
    # Elimination down the calendar and back up: a day's p by p block meets only its neighbours'.
    steps = [np.zeros((p, p))] * t
    b = np.empty((t, p))
    for k, r in enumerate(rows):
        near = ((k > 0) + (k < t - 1)) * smooth
        a = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]) + (ridge + near) * np.eye(p)
        c = np.array([r[f"c{i}"] for i in range(p)])
        if k:
            a, c = a - smooth * steps[k - 1], c + smooth * b[k - 1]
        steps[k] = np.linalg.solve(a, smooth * np.eye(p))
        b[k] = np.linalg.solve(a, c)
    for k in range(t - 2, -1, -1):
        b[k] += steps[k] @ b[k + 1]
    return {r["d"]: b[k] for k, r in enumerate(rows)}
