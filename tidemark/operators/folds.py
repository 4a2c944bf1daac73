"""Walk-forward folds and back-tests."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import next_day_rows, rolling_windows


def daily_folds(df: DataFrame, date: str, least: int = 0, below: int | None = None) -> DataFrame:
    """(date, train_rows, test_rows): rows strictly earlier and rows on the date; a fold is kept only if
    least < train_rows < below. The counts have one row per date."""
    counts = df.groupBy(date).agg(F.count("*").alias("test_rows"))
    w = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    out = counts.withColumn("train_rows", F.coalesce(F.sum("test_rows").over(w), F.lit(0)))
    out = out.where(F.col("train_rows") > least)
    return out if below is None else out.where(F.col("train_rows") < below)


def last_value_forecast(df: DataFrame, date: str, target: str, least: int = 0) -> DataFrame:
    """Each date's rows with the mean target of the date before: a last-value model refitted daily."""
    means = df.groupBy(date).agg(F.avg(target).alias("__m"), F.count("*").alias("__n"))
    w = Window.orderBy(date)
    seen = F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = means.select(date, F.when(seen > least, F.lag("__m").over(w)).alias("prediction"))
    return df.join(before, date)


def last_value(df: DataFrame, reference: str, target: str) -> DataFrame:
    """Mean target at the latest reference value."""
    by = df.where(F.col(reference).isNotNull()).groupBy(reference).agg(F.avg(target).alias("m"))
    return by.agg(F.max_by("m", reference).alias("prediction"))


def rolling_backtest(df: DataFrame, date: str, target: str, features: Sequence[str], n: int | None, fit_predict: Callable[[pd.DataFrame, pd.DataFrame], Sequence[float]], key: str) -> DataFrame:
    """For each run date: fit on the window that ends there, predict the next date's rows.

    Returns key, run_date, date, prediction and residual. Windows and next-day rows of a run date meet in one group, so
    a window must fit a task; models that reduce to sums should use windows instead.
    """
    missing = [c for c in [date, target, key, *features] if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")
    cols = list(dict.fromkeys([key, date, target, *features]))
    slim = df.select(*cols)
    train = rolling_windows(slim, date, n).select("run_date", *cols).toDF("run_date", *cols)
    test = next_day_rows(slim, date, n or 1).select("run_date", *cols).toDF("run_date", *cols)
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}
    schema = f"run_date {kinds[date]}, `{date}` {kinds[date]}, `{key}` {kinds[key]}, prediction double, residual double"

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"run_date": [], date: [], key: [], "prediction": [], "residual": []})
        right = right.sort_values(key)
        got = [float(x) for x in fit_predict(left, right)]
        return pd.DataFrame({"run_date": right["run_date"], date: right[date], key: right[key], "prediction": got, "residual": right[target].astype(float) - got})

    return train.groupBy("run_date").cogroup(test.groupBy("run_date")).applyInPandas(run, schema)


def rolling_mean_backtest(df: DataFrame, date: str, target: str, n: int, by: Sequence[str] = ()) -> DataFrame:
    """The same for the mean of a group's window, as windows over daily sums: nothing leaves the engine."""
    daily = df.groupBy(*by, date).agg(F.sum(target).alias("s"), F.count(target).alias("c"))
    ranks = df.select(date).distinct().withColumn("rk", F.row_number().over(Window.orderBy(date)))
    daily = daily.join(F.broadcast(ranks), date)
    w = Window.partitionBy(*by).orderBy("rk").rangeBetween(-(n - 1), 0)
    fitted = daily.select(*by, (F.col("rk") + 1).alias("rk"), F.col(date).alias("run_date"), F.try_divide(F.sum("s").over(w), F.sum("c").over(w)).alias("prediction")).where(F.col("rk") > n)
    rows = df.join(F.broadcast(ranks), date)
    return rows.join(fitted, [*by, "rk"]).drop("rk").withColumn("residual", F.col(target) - F.col("prediction"))


def grid_search(df: DataFrame, keys: Sequence[str], grid: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """score over every row of df with every parameter row of a small grid; results by score, best first."""
    return score(df.join(F.broadcast(grid))).orderBy(F.col("score").desc_nulls_last(), *keys)


def random_search(df: DataFrame, keys: Sequence[str], space: dict, draws: int, score: Callable[[DataFrame], DataFrame], seed: int = 0) -> DataFrame:
    """grid_search over draws from a space: a list of choices, (low, high), or (low, high, "log"), by parameter name."""
    import random

    rng = random.Random(seed)

    def draw(s):
        if isinstance(s, list):
            return rng.choice(s)
        if len(s) == 3:
            return float(s[0]) * (float(s[1]) / float(s[0])) ** rng.random()
        return rng.uniform(float(s[0]), float(s[1]))

    grid = df.sparkSession.createDataFrame([tuple(draw(s) for s in space.values()) for _ in range(draws)], list(space))
    return grid_search(df, keys, grid, score)


def mean_scores(scores: DataFrame, parameter: str) -> DataFrame:
    return scores.groupBy(parameter).agg(F.avg("score").alias("score"))
