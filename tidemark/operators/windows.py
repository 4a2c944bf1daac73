"""Per-series window operators. Every function takes the series key and an order that is unique within a series."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import nulls

Names = Sequence[str]


def over(keys: Names, order: Names):
    return Window.partitionBy(*keys).orderBy(*order)


def last_k(keys: Names, order: Names, k: int):
    return over(keys, order).rowsBetween(-(k - 1), 0)


def full(c: Column | str, agg: Column, w, k: int) -> Column:
    """A rolling aggregate, null until k values are present."""
    return F.when(F.count(nulls.col(c)).over(w) == k, agg.over(w))


def latest_n(df: DataFrame, keys: Names, date: str, n: int, tie: Names = ()) -> DataFrame:
    """The n latest rows per group; missing dates last, null keys dropped."""
    w = Window.partitionBy(*keys).orderBy(F.col(date).desc_nulls_last(), *tie)
    return df.dropna(subset=list(keys)).withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def combine_latest(frames: Sequence[DataFrame], keys: Names, order: Names) -> DataFrame:
    """One row per key: later frames win, then later rows by order. Null keys are one group."""
    from .sets import concat

    tagged = concat([f.withColumn("__src", F.lit(i)) for i, f in enumerate(frames)])
    w = Window.partitionBy(*keys).orderBy(F.col("__src").desc(), *[F.col(o).desc_nulls_last() for o in order])
    return tagged.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__src")


def ranks(df: DataFrame, keys: Names, order: Names, tiles: int) -> DataFrame:
    """tile (1 to tiles), percent_rank and cume_dist of every row in its group; rows alike in order share the last two."""
    w = over(keys, order)
    return df.withColumns({"tile": F.ntile(tiles).over(w), "percent_rank": F.percent_rank().over(w), "cume_dist": F.cume_dist().over(w)})


def nth(df: DataFrame, value: str, keys: Names, order: Names, n: int, out: str = "nth") -> DataFrame:
    """The n-th value of each whole group; null where it has fewer."""
    w = over(keys, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn(out, F.nth_value(value, n).over(w))


def within(df: DataFrame, agg: Column, keys: Names, at: Column, before: int, after: int = 0, out: str = "within") -> DataFrame:
    """An aggregate over the group's rows whose position at (a whole number, such as a day) lies from before under a row's
    own to after over it."""
    return df.withColumn(out, agg.over(Window.partitionBy(*keys).orderBy(at).rangeBetween(-before, after)))


def log_returns(df: DataFrame, price: str, keys: Names, order: Names, out: str = "log_return") -> DataFrame:
    """ln of each price over the one before. A price of zero gives -infinity, one after zero infinity; NaN where the ratio
    is negative or undefined, null where a price is missing."""
    df = df.withColumn("__ratio", nulls.divide(price, F.lag(price).over(over(keys, order))))
    r = F.col("__ratio")
    return df.withColumn(out, F.when(r == 0, F.lit(-math.inf)).when(r < 0, F.lit(math.nan)).otherwise(F.log(r))).drop("__ratio")


def simple_returns(df: DataFrame, price: str, keys: Names, order: Names, out: str = "ret") -> DataFrame:
    """Price over the one before, less 1. Infinite after a price of zero, NaN where both are zero, null where one is missing."""
    return df.withColumn(out, nulls.divide(price, F.lag(price).over(over(keys, order))) - 1)


def ewma(df: DataFrame, value: str, keys: Names, order: Names, com: float, out: str = "ewma") -> DataFrame:
    """Adjusted exponentially weighted mean: weights (1 - a)^distance in rows, a = 1 / (1 + com); missing values only age."""
    return series(df, keys, order, {out: "double"}, lambda f: {out: _ewma(f[value].to_numpy(dtype=float), com)})


def _ewma(x, com: float):
    import numpy as np

    keep, num, den, out = 1 - 1 / (1 + com), 0.0, 0.0, []
    for v in np.asarray(x, dtype=float).tolist():
        num, den = num * keep, den * keep
        if v == v:
            num, den = num + v, den + 1
        out.append(num / den if den > 0 else np.nan)
    return np.array(out)


def series(df: DataFrame, keys: Names, order: Names, outputs: dict[str, str], make) -> DataFrame:
    """make(series in order) -> columns, for recurrences that no window expresses.

    Rows are dealt out by key and sorted by the engine; a task walks its sorted Arrow batches, cuts them where the key
    changes and holds one unfinished series at a time. Null keys are one series.
    """
    import numpy as np
    import pandas as pd

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], *[f"`{n}` {t}" for n, t in outputs.items()]])

    def finished(f, starts, ends):
        parts = [make(f.iloc[a:b]) for a, b in zip(starts, ends, strict=True)]
        f = f.iloc[: ends[-1]].copy()
        for n, kind in outputs.items():
            if kind == "double":
                v = np.concatenate([np.asarray(p[n], dtype=float) for p in parts])
                f[n] = pd.array(v, dtype="Float64") if not np.isnan(v).any() else pd.arrays.FloatingArray(np.nan_to_num(v), np.isnan(v))
            else:
                f[n] = [x for p in parts for x in p[n]]
        return f

    def run(frames):
        held: list = []  # batches of the series that is still open
        for f in frames:
            if not len(f):
                continue
            row = pd.concat([held[-1].tail(1), f], ignore_index=True) if held else f
            new = np.zeros(len(row), dtype=bool)
            for k in keys:
                before = row[k].shift()
                new |= ((row[k] != before) & ~(row[k].isna() & before.isna())).to_numpy()
            new = new[1:] if held else np.append(True, new[1:])
            starts = np.flatnonzero(new)
            if not len(starts):
                held.append(f)
                continue
            if held:
                whole = pd.concat([*held, f.iloc[: starts[0]]], ignore_index=True)
                yield finished(whole, [0], [len(whole)])
            if len(starts) > 1:
                yield finished(f.iloc[starts[0] :].reset_index(drop=True), starts[:-1] - starts[0], starts[1:] - starts[0])
            held = [f.iloc[starts[-1] :].reset_index(drop=True)]
        if held:
            whole = pd.concat(held, ignore_index=True)
            yield finished(whole, [0], [len(whole)])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def ex_ante_volatility(df: DataFrame, returns: str, keys: Names, order: Names, com: float = 60, factor: float = 261, out: str = "volatility") -> DataFrame:
    """Square root of the annualised adjusted EWMA of squared distances from the adjusted EWMA."""
    import numpy as np

    def make(f):
        r = f[returns].to_numpy(dtype=float)
        return {out: np.sqrt(_ewma((r - _ewma(r, com)) ** 2, com) * factor)}

    return series(df, keys, order, {out: "double"}, make)


def momentum(df: DataFrame, returns: str, keys: Names, order: Names, k: int, lag: int = 0, out: str = "signal") -> DataFrame:
    """Sign of the rolling sum of k returns; lag rows are left out first."""
    src = returns
    if lag:
        df = df.withColumn("__r", F.lag(returns, lag).over(over(keys, order)))
        src = "__r"
    w = last_k(keys, order, k)
    return df.withColumn(out, F.signum(full(src, F.sum(src), w, k))).drop("__r")


def bollinger(df: DataFrame, price: str, keys: Names, order: Names, k: int = 20, width: float = 2.0) -> DataFrame:
    """Rolling mean, deviation, bands, z distance and band signal."""
    w = last_k(keys, order, k)
    df = df.withColumn("ma", full(price, F.avg(price), w, k)).withColumn("sd", full(price, F.stddev_samp(price), w, k))
    df = df.withColumn("upper", F.col("ma") + width * F.col("sd")).withColumn("lower", F.col("ma") - width * F.col("sd"))
    df = df.withColumn("z", F.try_divide(F.col(price) - F.col("ma"), F.col("sd")))
    return df.withColumn("signal", band_signal(price, "upper", "lower"))


def band_signal(price: str, upper: str, lower: str) -> Column:
    """1 at or under the lower band, else -1 at or over the upper one, else null."""
    return F.when(F.col(price) <= F.col(lower), 1).when(F.col(price) >= F.col(upper), -1)


def regime_features(df: DataFrame, value: str, keys: Names, order: Names, widths: Sequence[int] = (6, 14)) -> DataFrame:
    """Value, absolute change and the one before, and for each width the mean and deviation of the window and its halves;
    rows with anything missing are dropped."""
    w = over(keys, order)
    df = df.withColumn("obs", F.col(value)).withColumn("abs_diff", F.abs(F.col(value) - F.lag(value).over(w)))
    df = df.withColumn("prev_abs_diff", F.lag("abs_diff").over(w))
    names = ["obs", "abs_diff", "prev_abs_diff"]
    for k in widths:
        h = k // 2
        for tag, frame, n in (("", w.rowsBetween(-(k - 1), 0), k), ("_left", w.rowsBetween(-(k - 1), -h), k - h), ("_right", w.rowsBetween(-(h - 1), 0), h)):
            df = df.withColumn(f"mean{tag}_{k}", full(value, F.avg(value), frame, n)).withColumn(f"std{tag}_{k}", full(value, F.stddev_samp(value), frame, n))
            names += [f"mean{tag}_{k}", f"std{tag}_{k}"]
    return df.dropna(subset=names)


def standardize(df: DataFrame, columns: Names, keys: Names = ()) -> DataFrame:
    """(x - mean) / population deviation of each key's rows."""
    stats = df.groupBy(*keys).agg(*[a for c in columns for a in (F.avg(c).alias(f"__m_{c}"), F.stddev_pop(c).alias(f"__s_{c}"))])
    joined = df.join(F.broadcast(stats)) if not keys else df.join(stats, list(keys))
    return joined.withColumns({c: F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}")) for c in columns}).select(*df.columns)


def running_product(factor: Column, w) -> Column:
    """Product of factors up to this row; missing ones are passed over."""
    return F.product(factor).over(w.rowsBetween(Window.unboundedPreceding, 0))


def drawdown(df: DataFrame, returns: str, keys: Names, order: Names) -> DataFrame:
    """Adds wealth, the running product of 1 + r, and its distance from its running maximum."""
    w = over(keys, order)
    df = df.withColumn("wealth", running_product(1 + F.col(returns), w))
    return df.withColumn("drawdown", F.try_divide(F.col("wealth"), F.max("wealth").over(w.rowsBetween(Window.unboundedPreceding, 0))) - 1)


def cross_correlation(df: DataFrame, x: str, y: str, keys: Names, order: Names, k: int) -> DataFrame:
    """(keys, lag, corr) of x at t with y at t - lag, for lags -k to k."""
    w = over(keys, order)
    wide = df.select(*keys, x, *[(F.lag(y, j) if j >= 0 else F.lead(y, -j)).over(w).alias(f"y{j + k}") for j in range(-k, k + 1)])
    made = wide.groupBy(*keys).agg(*[F.corr(x, f"y{j}").alias(f"c{j}") for j in range(2 * k + 1)])
    pairs = F.explode(F.array(*[F.struct(F.lit(j - k).alias("lag"), F.col(f"c{j}").alias("corr")) for j in range(2 * k + 1)]))
    return made.select(*keys, pairs.alias("p")).select(*keys, "p.lag", "p.corr")


def group_features(df: DataFrame, value: str, keys: Names, order: Names, k: int = 3) -> DataFrame:
    """Shift, rolling mean, group mean, z-score, average rank, fills by group mean and by neighbours."""
    w, whole = over(keys, order), Window.partitionBy(*keys)
    ranks = Window.partitionBy(*keys).orderBy(value)
    ties = Window.partitionBy(*keys, value)
    rank = F.rank().over(ranks) + (F.count("*").over(ties) - 1) / 2
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumns({
        "shifted": F.lag(value).over(w),
        "rolling": full(value, F.avg(value), last_k(keys, order, k), k),
        "group_mean": F.avg(value).over(whole),
        "z": F.try_divide(F.col(value) - F.avg(value).over(whole), F.stddev_samp(value).over(whole)),
        "avg_rank": rank.cast("double"),
        "mean_filled": F.coalesce(value, F.avg(value).over(whole)),
        "filled": F.coalesce(before, after),
    })


def date_index(df: DataFrame, date: str, known: DataFrame | None = None) -> DataFrame:
    """(date, idx): places of distinct dates from 0; unseen dates follow the known ones in order."""
    dates = df.select(date).where(F.col(date).isNotNull()).distinct()
    if known is None:
        # One row per date: the table is as long as the calendar, whatever the data's size.
        return dates.withColumn("idx", F.row_number().over(Window.orderBy(date)) - 1)
    top = known.agg(F.coalesce(F.max("idx"), F.lit(-1)).alias("top"))
    new = dates.join(known.select(date), date, "left_anti").join(F.broadcast(top))
    return known.select(date, "idx").unionByName(new.select(date, (F.col("top") + F.row_number().over(Window.orderBy(date))).cast("int").alias("idx")))


def recency_weights(df: DataFrame, date: str, rate: float, offset: float, out: str = "weight") -> DataFrame:
    """1 / (1 + exp(rate * (days - offset))), days counted back from the last date."""
    last = df.agg(F.max(date).alias("__last"))
    days = F.datediff(F.col("__last"), F.col(date))
    return df.join(F.broadcast(last)).withColumn(out, 1 / (1 + F.exp(F.lit(rate) * (days - F.lit(offset))))).drop("__last")


def strategy_returns(df: DataFrame, position: str, price: str, keys: Names, order: Names) -> DataFrame:
    """Position times simple return, and its running product, which passes over missing and undefined (NaN) returns."""
    w = over(keys, order)
    df = simple_returns(df, price, keys, order, "__ret").withColumn("strategy_return", F.col(position) * F.col("__ret")).drop("__ret")
    return df.withColumn("strategy_wealth", running_product(nulls.clean(1 + F.col("strategy_return")), w))


def rolling_regression(df: DataFrame, y: str, x: str, keys: Names, order: Names, back: int) -> DataFrame:
    """One-factor least squares over the last back + 1 rows: slope, intercept, R squared, residual and its running product."""
    w = over(keys, order).rowsBetween(-back, 0)
    enough = F.count("*").over(w) == back + 1
    df = df.withColumn("slope", F.when(enough, F.regr_slope(y, x).over(w))).withColumn("intercept", F.when(enough, F.regr_intercept(y, x).over(w)))
    df = df.withColumn("r2", F.when(enough, F.regr_r2(y, x).over(w))).withColumn("residual", F.col(y) - F.col("intercept") - F.col("slope") * F.col(x))
    return df.withColumn("residual_wealth", running_product(1 + F.col("residual"), over(keys, order)))
