"""Lookups, as-of and band joins, identifier resolution, rule tables and upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import nulls


def lookup(ids: DataFrame, table: DataFrame, source: str, target: str, position: str = "pos") -> DataFrame:
    """ids (position, id) with the target of each id in their order and number; unmatched ids give null."""
    known = table.where(F.col(target).isNotNull()).select(F.col(source).alias("id"), F.col(target).alias(target))
    return ids.join(known, "id", "left").select(position, "id", target)


def resolve_mixed(ids: DataFrame, table: DataFrame, columns: Sequence[str], target: str, invalid: DataFrame | None = None) -> DataFrame:
    """ids (pos, id) resolved against any of the columns: the first column in order that knows an id wins.

    Status is Success, else Invalid for listed ids, else NotFound. The columns are unpivoted, so that one equi-join does.
    """
    pairs = F.explode(F.array(*[F.struct(F.col(c).cast("string").alias("id"), F.lit(i).alias("rank"), F.col(target).alias("target")) for i, c in enumerate(columns)]))
    known = table.select(pairs.alias("p")).select("p.*").where("id is not null and target is not null")
    best = known.groupBy("id").agg(F.min(F.struct("rank", "target"))["target"].alias(target))
    out = ids.join(best, "id", "left")
    status = F.when(F.col(target).isNotNull(), "Success")
    if invalid is not None:
        out = out.join(invalid.select(F.col("id"), F.lit(True).alias("__bad")).distinct(), "id", "left")
        status = status.when(F.col("__bad"), "Invalid")
    return out.select("pos", "id", target, status.otherwise("NotFound").alias("status"))


def exist_flags(ids: DataFrame, table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """ids with a flag: whether any of the columns holds the id."""
    every = F.explode(F.array(*[F.col(c).cast("string") for c in columns]))
    known = table.select(every.alias("id")).where("id is not null").distinct().withColumn("__in", F.lit(True))
    return ids.join(known, "id", "left").withColumn("exists", F.coalesce("__in", F.lit(False))).drop("__in")


def align(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b, list(keys))


def constant_shift(a: DataFrame, b: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """mean(y) - mean(x) over keys where both are present; an error if there are none."""
    both = align(a, b, keys).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    shift = F.when(F.count("*") == 0, F.raise_error(F.lit("no overlap")).cast("double")).otherwise(F.avg(y) - F.avg(x))
    return both.agg(shift.alias("shift"))


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, values: Sequence[str], found: str = "as_of_time", slices: str | None = None) -> DataFrame:
    """Each left row with the values of the latest right row of its keys at or before its time.

    One union, one exchange and one running last: linear however many rows share a key and time. With slices (a unit such
    as day or hour) a key's rows are dealt out by time slice as well, so that no task holds all rows of a hot key; the
    last state before each slice comes from a table of one row per key and slice.
    """
    names, part = left.columns, list(keys)
    state = F.struct(F.col(right_time).alias("t"), *values)
    kind = right.select(state.alias("s")).schema["s"].dataType
    a = left.select(*names, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(kind).alias("__s"))
    b = right.select(*keys, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), state.alias("__s"))
    both = a.unionByName(b, allowMissingColumns=True)
    if slices:
        part = [*keys, "__slice"]
        both = both.withColumn("__slice", F.date_trunc(slices, "__t"))
    w = Window.partitionBy(*part).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__last", F.last("__s", ignorenulls=True).over(w)).where("__side = 1")
    if slices:
        ends = both.groupBy(*part).agg(F.max_by("__s", F.when(F.col("__side") == 0, F.struct("__t"))).alias("__end"))
        before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.withColumn("__held", F.last("__end", ignorenulls=True).over(before)).select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(part)], "__held")
        same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(part)]
        out = out.join(ends, same, "left").withColumn("__last", F.coalesce("__last", "__held"))
    return out.select(*names, F.col("__last.t").alias(found), *[F.col(f"__last.{v}").alias(v) for v in values])


def as_of_decayed(left: DataFrame, right: DataFrame, keys: Sequence[str], left_day: str, right_day: str, value: str, life: float) -> DataFrame:
    """As-of value that halves every life days of gap; exact matches don't decay."""
    import math

    out = as_of(left, right, keys, left_day, right_day, [value])
    gap = F.datediff(F.col(left_day), F.col("as_of_time")).cast("double")
    return out.withColumn(value, F.col(value) * F.exp(-F.lit(math.log(2) / life) * gap))


def _slice(df: DataFrame, c: str, width: float) -> Column:
    """Number of the slice of width that a number, a date (days) or a time (seconds, on its own clock without a zone) is in."""
    kind = df.schema[c].dataType.typeName()
    if kind == "timestamp_ntz":
        at = F.unix_date(F.to_date(c)) * 86400.0 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    else:
        at = F.unix_date(c) if kind == "date" else F.col(c).cast("double")
    return F.floor(at / F.lit(float(width)))


def interval_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str, end: str, width: float) -> DataFrame:
    """Every point with each interval of its keys that holds it, both ends included; columns besides keys must differ.

    Points go to the slice of width (seconds, days of a date, or units of a number) they lie in, intervals to all slices
    they touch, and an equi-join on keys and slice is checked exactly: a pair meets once, no task holds all of a hot key,
    and nothing is compared across slices. width near the usual length of an interval keeps both sides short. Null keys
    or places, and intervals that end before they start, match nothing.
    """
    dealt = intervals.where(F.col(start) <= F.col(end))
    dealt = dealt.withColumn("__slice", F.explode(F.sequence(_slice(dealt, start, width), _slice(dealt, end, width))))
    met = points.withColumn("__slice", _slice(points, at, width)).join(dealt, [*keys, "__slice"])
    return met.where(F.col(at).between(F.col(start), F.col(end))).drop("__slice")


def date_ranks(df: DataFrame, date: str) -> DataFrame:
    """(date, rk) over the distinct dates."""
    return df.select(date).where(F.col(date).isNotNull()).distinct().withColumn("rk", F.row_number().over(Window.orderBy(date)))


def rolling_windows(df: DataFrame, date: str, n: int | None) -> DataFrame:
    """Rows of the last n distinct dates up to each run date (all history for None), keyed by run_date.

    Run dates are the n-th to the last but one. Each row is expanded to the n run dates that see it, an equi-join on
    its date. With all history a row meets every later run date, so that the output grows with the square of the calendar;
    models that reduce to sums should take running windows over daily sums instead.
    """
    ranks = date_ranks(df, date)
    if n is None:
        last = ranks.agg(F.max("rk").alias("__top"))
        cal = ranks.join(F.broadcast(last)).select(date, F.explode(F.sequence("rk", F.greatest("rk", F.col("__top") - 1))).alias("run")).where("true")
    else:
        cal = ranks.select(date, F.explode(F.sequence(F.col("rk"), F.col("rk") + n - 1)).alias("run")).where(F.col("run") >= n)
    runs = ranks.select(F.col(date).alias("run_date"), F.col("rk").alias("run"))
    nexts = ranks.select((F.col("rk") - 1).alias("run"), F.col(date).alias("next_date"))
    cal = cal.join(runs, "run").join(nexts, "run").select(date, "run_date", "next_date")
    return df.join(cal, date)


def next_day_rows(df: DataFrame, date: str, n: int = 1) -> DataFrame:
    """Rows keyed by the run date before them: the distinct date that precedes theirs, from the n-th date on."""
    ranks = date_ranks(df, date)
    runs = ranks.where(F.col("rk") >= n).select(F.col(date).alias("run_date"), (F.col("rk") + 1).alias("rk"))
    return df.join(ranks.join(runs, "rk").drop("rk"), date)


def expand_periods(df: DataFrame, count: str, out: str = "period") -> DataFrame:
    """One row per period from 0 to count."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), F.col(count))))


#: Queries and points that meet in a task, about.
QUERY_BLOCK, POINT_PART = 16_384, 32_768


def nearest(queries: DataFrame, points: DataFrame, query_id: str, point_id: str, query_vector: str, point_vector: str, k: int, value: str | None = None) -> DataFrame:
    """(q_id, p_id, distance[, value], rank): the k nearest points of each query by Euclidean distance, ranks from 0,
    ties by id. Ids are numbers.

    Points are dealt into parts of about POINT_PART and queries into blocks of about QUERY_BLOCK by hash; each part meets
    each block in a task of its own, which gives k points per query (more where ids have to break a tie), so that pairs
    are never expanded and nothing is gathered on the driver. A block's k best of all parts are then ranked.
    """
    import numpy as np
    import pandas as pd

    spread = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    slim = points.select(F.col(point_id).cast("long").alias("p_id"), F.col(point_vector).cast("array<double>").alias("v"), *([F.col(value).cast("double").alias(value)] if value else []))
    asked = queries.select(F.col(query_id).cast("long").alias("id"), F.col(query_vector).cast("array<double>").alias("v"))
    parts = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-slim.count() // POINT_PART))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    left = slim.select("*", spread("p_id", parts).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = asked.select("*", spread("id", blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    names = ["q_id", "p_id", "distance", *([value] if value else [])]

    def meet(key: tuple, pts: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        if not len(pts) or not len(qs):
            return pd.DataFrame({c: [] for c in names}, dtype=float)
        x, out = np.stack(pts["v"].tolist()), []
        for lo in range(0, len(qs), 512):
            ids, m = qs["id"].to_numpy()[lo : lo + 512], np.stack(qs["v"].tolist()[lo : lo + 512])
            d = np.sqrt(np.maximum(0, (m * m).sum(1)[:, None] - 2 * m @ x.T + (x * x).sum(1)[None, :]))
            edge = np.partition(d, k - 1, axis=1)[:, k - 1] if k < d.shape[1] else d.max(1)
            q, p = np.nonzero(d <= edge[:, None] + 1e-6)  # ties at the edge stay until ids decide
            exact = np.sqrt(((m[q] - x[p]) ** 2).sum(1))
            out.append(pd.DataFrame({"q_id": ids[q], "p_id": pts["p_id"].to_numpy()[p], "distance": exact} | ({value: pts[value].to_numpy()[p]} if value else {})))
        return pd.concat(out)

    schema = "q_id long, p_id long, distance double" + (f", `{value}` double" if value else "")
    found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(meet, schema)
    w = Window.partitionBy("q_id").orderBy("distance", "p_id")
    return found.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def bounds_by_rules(df: DataFrame, rules: DataFrame, feature: str, dims: Sequence[str], wildcard: str = "*") -> DataFrame:
    """df with floor and cap from the most specific fitting rule.

    rules: feature, one column per dimension (wildcard for any), floor, cap. Dimensions rank by name: with two, (a, b),
    (a, *), (*, b), (*, *); with one, exact then *; with more, all exact then all *. A missing value fits wildcards only.
    Each pattern of wildcards is one equi-join, so that no rule is tested against every row.
    """
    names = sorted(dims)
    patterns = [(True, True), (True, False), (False, True), (False, False)] if len(names) == 2 else [(True,) * len(names), (False,) * len(names)]
    mine = rules.where(F.col("feature") == feature)
    floors, caps = [], []
    for i, exact in enumerate(patterns):
        own = mine
        for n, e in zip(names, exact, strict=True):
            own = own.where(F.col(n) != wildcard) if e else own.where(F.col(n) == wildcard)
        on = [n for n, e in zip(names, exact, strict=True) if e]
        part = own.select(*on, F.struct("floor", "cap").alias(f"__r{i}"))
        df = df.join(part, on, "left") if on else df.join(F.broadcast(part.agg(F.first(f"__r{i}").alias(f"__r{i}"))))
        floors.append(f"__r{i}")
    best = F.coalesce(*[F.col(c) for c in floors])
    return df.withColumn("__b", best).withColumn("floor", F.col("__b.floor")).withColumn("cap", F.col("__b.cap")).drop("__b", *floors, *caps)


def cap_floor(df: DataFrame, rules: DataFrame, feature: str, dims: Sequence[str], out: str | None = None) -> DataFrame:
    got = bounds_by_rules(df, rules, feature, dims)
    return got.withColumn(out or feature, nulls.clip(feature, F.col("floor"), F.col("cap"))).drop("floor", "cap")


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], order: Column | None = None) -> DataFrame:
    """target with the source's rows in place of those of equal key, and new keys added.

    Of several source rows with a key the one with the largest order wins (without order, keys must be unique). Columns
    that the source lacks keep the target's value; rows with a null key are left out of the source.
    """
    keys = list(keys)
    src = source.select(*[c for c in source.columns if c in target.columns]).dropna(subset=keys) if order is None else source.dropna(subset=keys)
    if order is not None:
        w = Window.partitionBy(*keys).orderBy(order.desc_nulls_last())
        src = src.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").select(*[c for c in source.columns if c in target.columns])
    sent = [c for c in src.columns if c not in keys]
    new = src.select(*keys, F.struct(F.lit(True).alias("__in"), *sent).alias("__new"))
    old = target.withColumn("__old", F.lit(True))
    both = old.join(new, keys, "full_outer")
    pick = [F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in sent else F.col(c) for c in target.columns]
    return both.select(*pick)


def upsert_counts(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many keys of the source are new and how many replace rows."""
    known = target.select(*keys).distinct().withColumn("__in", F.lit(1))
    flagged = source.dropna(subset=list(keys)).select(*keys).distinct().join(known, list(keys), "left")
    return flagged.agg(F.coalesce(F.sum(F.col("__in").isNull().cast("long")), F.lit(0)).alias("inserted"), F.count("__in").alias("updated"))


def insert_ignore(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """target and the source's rows of keys that it lacks, one per key."""
    new = source.dropna(subset=list(keys)).dropDuplicates(list(keys)).join(target.select(*keys), list(keys), "left_anti")
    return target.unionByName(new.select(*target.columns))
