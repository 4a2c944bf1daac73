"""Aggregations: flexible group rows, binned means, implied actuals, distributions, performance and losses."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, nulls
from . import binning

Order = Sequence[str]


def _method(name: str, how, weight: str | None, order: Column) -> Column:
    c = F.col(name)
    if callable(how):
        return how(c)
    if how == "first":
        return F.min_by(F.struct(c), order)[name]
    if how == "last":
        return F.max_by(F.struct(c), order)[name]
    if how == "mean":
        return F.avg(c)
    if how == "sum":
        return F.coalesce(F.sum(c), F.lit(0))
    if how == "wavg":
        if weight is None:
            raise ValueError("wavg needs a weight column")
        return nulls.weighted_mean(c, weight)
    if how in ("min", "max", "count"):
        return getattr(F, how)(c)
    raise ValueError(f"unknown method {how!r}")


def aggregate_flex(df: DataFrame, keys: Sequence[str], order: Order, weight: str | None = None, default="first", overrides: dict | None = None) -> DataFrame:
    """One row per group; each other column by its method. Null keys are dropped; order must be unique in a group."""
    overrides = overrides or {}
    if weight is None and "wavg" in [default, *overrides.values()]:
        raise ValueError("wavg needs a weight column")
    by = F.struct(*order)
    rest = [c for c in df.columns if c not in keys]
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(*[_method(c, overrides.get(c, default), weight, by).alias(c) for c in rest])


def collapse_duplicates(df: DataFrame, keys: Sequence[str], order: Order, overrides: dict[str, Callable[[Column], Column] | str] | None = None) -> DataFrame:
    """One row per group: the first present value of each column."""
    overrides, by = overrides or {}, F.struct(*order)
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), by))
    made = [(_method(c, overrides[c], None, by) if c in overrides else first(c)).alias(c) for c in df.columns if c not in keys]
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(*made)


def binned_means(df: DataFrame, x: str, actual: str, predictions: Sequence[str] = (), weight: str | None = None, facet: Sequence[str] = (), strategy="step", n_bins: int = 10, step: float = 1.0, edges=None, min_count: int = 0, sizes: tuple[float, float] | None = None) -> DataFrame:
    """(facet..., bin_val, actual, predictions..., count): weighted means of each observed (facet, bin).

    Zero total weight gives null; bins of fewer than min_count rows go; sizes adds bubble_size, the count scaled to them.
    """
    slim = df.select(*dict.fromkeys([*facet, x, actual, *predictions, *([weight] if weight else [])]))
    binned = slim.withColumn("bin_val", binning.bin_column(slim, x, strategy, n_bins, step, edges)).where("bin_val is not null")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    means = [nulls.weighted_mean(c, w).alias(f"{c}_mean") for c in (actual, *predictions)]
    out = binned.groupBy(*facet, "bin_val").agg(*means, F.count("*").alias("count"))
    if min_count:
        out = out.where(F.col("count") >= min_count)
    if sizes:
        # One row per bin is left, so that the totals below are over a small table.
        ends = out.agg(F.min("count").alias("__lo"), F.max("count").alias("__hi"))
        share = F.coalesce(F.try_divide(F.col("count") - F.col("__lo"), F.col("__hi") - F.col("__lo")), F.lit(1.0))
        out = out.join(F.broadcast(ends)).withColumn("bubble_size", F.lit(sizes[0]) + share * (sizes[1] - sizes[0])).drop("__lo", "__hi")
    return out


def binned_band(df: DataFrame, x: str, ys: Sequence[str], cutoffs: Sequence[float], include_inf: bool = True, style: str = "simple", side: str = "mid", err: str = "std", k: float = 1.0, decimals: int = 2) -> DataFrame:
    """Per bin: label, center, count and, for each y, mean and mean -/+ k * std (or k * std / sqrt(rows))."""
    edges = binning.edges_of(cutoffs, include_inf, decimals)
    labels, mids = binning.labels_of(edges, style, decimals=decimals), binning.centers(edges, side)
    made = [F.count("*").alias("count")]
    for y in ys:
        width = F.stddev_samp(y) * k
        width = width / F.sqrt(F.count("*")) if err == "sem" else width
        made += [F.avg(y).alias(f"{y}_mean"), (F.avg(y) - width).alias(f"{y}_low"), (F.avg(y) + width).alias(f"{y}_high")]
    binned = df.select(x, *ys).withColumn("label", binning.pick(x, edges, labels)).withColumn("center", binning.pick(x, edges, mids))
    return binned.where("label is not null").groupBy("label", "center").agg(*made)


def implied_actual(df: DataFrame, keys: Sequence[str], y: str, others: str, weight: str | None = None, loss: str = "mse") -> DataFrame:
    """Per bin, the factor that the data imply: sum(w m y) / sum(w m^2), or sum(w y / p) / sum(w m / p) with p >= 1e-10
    for the poisson loss, where m is the product of the other blocks; 0 where the denominator is about 0."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    m = F.col(others)
    if loss == "mse":
        top, low = F.sum(w * m * F.col(y)), F.sum(w * m * m)
    else:
        p = F.greatest(m, F.lit(1e-10))
        top, low = F.sum(w * F.col(y) / p), F.sum(w * m / p)
    value = F.when(F.abs(low) < 1e-8, F.lit(0.0)).otherwise(F.try_divide(top, low))
    return df.groupBy(*keys).agg(value.alias("implied"), F.avg(m).alias("model_mean"), F.count("*").alias("count"))


def decayed_means(df: DataFrame, x: str, y: str, date: str, cutoffs: Sequence[float], as_of: Column, life: float = 14.0, keys: Sequence[str] = ()) -> DataFrame:
    """Per bin of x: mean of y with weights that halve every life days before as_of; the bin's point, weights as count."""
    edges = binning.edges_of(cutoffs, True, 10)
    w = dates.half_life(F.datediff(as_of, F.col(date)).cast("double"), life)
    slim = df.withColumn("point", binning.pick(x, edges, binning.centers(edges))).withColumn("__w", w)
    return slim.where("point is not null").groupBy(*keys, "point").agg(nulls.weighted_mean(y, "__w").alias("value"), F.sum("__w").alias("count"))


def numeric_summary(df: DataFrame, column: str) -> DataFrame:
    c = column
    return df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.median(c).alias("median"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(left, right, count, density) of equal-width bins; empty bins are left out."""
    lo, hi, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if n == 0:
        return df.sparkSession.createDataFrame([], "left double, right double, count long, density double")
    width = (float(hi) - float(lo)) / bins or 1.0
    at = F.least(F.floor((F.col(column) - float(lo)) / width), F.lit(bins - 1))
    out = df.where(F.col(column).isNotNull()).groupBy(at.alias("i")).agg(F.count("*").alias("count"))
    return out.select((F.col("i") * width + float(lo)).alias("left"), ((F.col("i") + 1) * width + float(lo)).alias("right"), "count", (F.col("count") / (n * width)).alias("density"))


def top_values(df: DataFrame, column: str, most: int = 10, other: str = "Other") -> DataFrame:
    """(value, count) of the most - 1 commonest values, ties by value, and all others together."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("count"))
    kept = counts.orderBy(F.col("count").desc(), "value").limit(most - 1).select("value", F.lit(True).alias("__kept"))
    name = F.when(F.col("__kept"), F.col("value")).otherwise(F.lit(other))
    return counts.join(F.broadcast(kept), "value", "left").groupBy(name.alias("value")).agg(F.sum("count").alias("count"))


def state_stats(df: DataFrame, value: str, state: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and standard deviation (of the population) in each state."""
    return df.groupBy(*keys, state).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def relabel_states(df: DataFrame, value: str, state: str, keys: Sequence[str] = ()) -> DataFrame:
    """state renumbered from 0 by ascending volatility."""
    w = Window.partitionBy(*keys).orderBy("std", state)
    ranks = state_stats(df, value, state, keys).withColumn("__new", F.row_number().over(w) - 1).select(*keys, state, "__new")
    return df.join(ranks, [*keys, state]).withColumn(state, F.col("__new").cast("int")).drop("__new")


def order_agrees(df: DataFrame, returns: str, value: str, state: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, agrees): whether mean returns fall as the volatility of value rises from state to state."""
    by = df.groupBy(*keys, state).agg(F.stddev_pop(value).alias("std"), F.avg(returns).alias("mean"))
    w = Window.partitionBy(*keys).orderBy("std", state)
    steps = by.withColumn("ok", F.coalesce(F.col("mean") <= F.lag("mean").over(w), F.lit(True)))
    return steps.groupBy(*keys).agg(F.bool_and("ok").alias("agrees"))


def flip_two_states(df: DataFrame, returns: str, probability: str, keys: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """probability made that of the state of higher volatility: it is flipped to 1 - probability where returns vary more
    (deviation of the population) on rows below the threshold than on the others; flipped tells. Two keyed sums."""
    low = F.col(probability) < threshold
    spread = df.groupBy(*keys).agg(nulls.holds(F.stddev_pop(F.when(low, F.col(returns))) > F.stddev_pop(F.when(nulls.holds(~low) | F.col(probability).isNull(), F.col(returns)))).alias("flipped"))
    both = df.join(spread, list(keys)) if keys else df.crossJoin(F.broadcast(spread))  # one row
    return both.withColumn(probability, F.when(F.col("flipped"), 1 - F.col(probability)).otherwise(F.col(probability)))


def balanced_accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Mean over classes of the share found."""
    per = df.where(F.col(truth).isNotNull()).groupBy(truth).agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("recall"))
    return per.agg(F.avg("recall").alias("balanced_accuracy"))


def mapping(df: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct (key, value); an error where a key has more than one value."""
    n = F.count_distinct(value) + F.max(F.col(value).isNull().cast("int"))
    checked = F.when(n > 1, F.raise_error(F.concat(F.lit("several values for key "), F.col(key).cast("string")))).otherwise(F.lit(True))
    return df.groupBy(key).agg(F.min(value).alias(value), checked.alias("__ok")).where("__ok").drop("__ok")


def sharpe(c: str, periods: int = 252) -> Column:
    return F.lit(math.sqrt(periods)) * F.try_divide(F.avg(c), F.stddev_samp(c))


def performance(df: DataFrame, returns: str, keys: Sequence[str], order: Order, periods: int = 252) -> DataFrame:
    """Annual return and volatility, Sharpe ratio, largest drawdown and number of non-zero returns of each key."""
    from .windows import drawdown

    down = drawdown(df, returns, keys, order)
    return down.groupBy(*keys).agg(
        (F.avg(returns) * periods).alias("annual_return"),
        (F.stddev_samp(returns) * math.sqrt(periods)).alias("annual_volatility"),
        sharpe(returns, periods).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"),
        F.coalesce(F.sum((F.col(returns) != 0).cast("long")), F.lit(0)).alias("trades"),
    )


def mean_absolute_error(a: str, b: str) -> Column:
    return F.avg(F.abs(F.col(a) - F.col(b)))


def _weighted(term: Column, weight: str | None) -> Column:
    return F.avg(term) if weight is None else F.try_divide(F.sum(term * F.col(weight)), F.sum(weight))


def log_loss(y: str, p: str, weight: str | None = None, eps: float = 1e-15) -> Column:
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    return _weighted(-(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q)), weight)


def mse(y: str, p: str, weight: str | None = None) -> Column:
    return _weighted((F.col(y) - F.col(p)) ** 2, weight)


def poisson_deviance(y: str, p: str, weight: str | None = None) -> Column:
    a, b = F.col(y), F.greatest(F.col(p), F.lit(1e-10))
    return _weighted(2 * (F.when(a > 0, a * F.log(a / b)).otherwise(F.lit(0.0)) - (a - b)), weight)


def epsilon_insensitive(y: str, p: str, eps: float, weight: str | None = None) -> Column:
    return _weighted(F.greatest(F.abs(F.col(y) - F.col(p)) - eps, F.lit(0.0)), weight)


def loan_performance(df: DataFrame, keys: Sequence[str], paid: str, weight: str | None = None) -> DataFrame:
    """Single-month mortality and its annual rate by group."""
    smm = nulls.weighted_mean(F.col(paid).cast("double"), F.col(weight) if weight else F.lit(1.0))
    return df.groupBy(*keys).agg(smm.alias("smm"), F.count("*").alias("loans")).withColumn("cpr", 1 - F.pow(1 - F.col("smm"), F.lit(12.0)))


def survival(df: DataFrame, cohort: Sequence[str], age: str, paid: str, originated: str) -> DataFrame:
    """Per cohort and age: share of the originated number that has not been paid off up to that age."""
    w = Window.partitionBy(*cohort).orderBy(age).rowsBetween(Window.unboundedPreceding, 0)
    by_age = df.groupBy(*cohort, age).agg(F.sum(paid).alias("paid"), F.max(originated).alias("originated"))
    return by_age.withColumn("survival", 1 - F.try_divide(F.sum("paid").over(w), F.col("originated")))


def curve_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), (F.max(value) - F.min(value)).alias("range"))


def top_by_size(df: DataFrame, value: str, n: int, tie: str) -> DataFrame:
    """The n rows of largest absolute value."""
    return df.orderBy(F.abs(F.col(value)).desc_nulls_last(), tie).limit(n)


def rollups(df: DataFrame, keys: Sequence[str], value: str, kind: str = "rollup") -> DataFrame:
    """Sums and counts over all prefixes (rollup) or subsets (cube) of the keys."""
    return getattr(df, kind)(*keys).agg(F.sum(value).alias("total"), F.count("*").alias("n"), F.grouping_id().alias("level"))
