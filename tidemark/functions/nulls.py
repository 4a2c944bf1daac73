"""Column helpers that carry data-frame rules for missing values into SQL.

Missing means null; NaN is turned into null on the way in (``clean``). Comparisons with missing values are false, except
that ``!=`` and ``not in`` keep missing rows.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: Column | str) -> Column:
    """NaN becomes null."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def clean_frame(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: clean(F.col(f"`{f.name}`")) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def is_missing(c: Column | str) -> Column:
    """Null, NaN or infinite."""
    c = col(c).cast("double")
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def finite(c: Column | str) -> Column:
    c = col(c)
    return F.when(~is_missing(c), c)


def ne(c: Column | str, value) -> Column:
    return ~col(c).eqNullSafe(F.lit(value))


def not_in(c: Column | str, values) -> Column:
    return F.coalesce(~col(c).isin(list(values)), F.lit(True))


def holds(condition: Column) -> Column:
    """A condition as a mask: unknown is false."""
    return F.coalesce(condition, F.lit(False))


def clip(c: Column | str, low=None, high=None) -> Column:
    """Bounds of None, and null bounds, don't bind; missing values stay missing."""
    c = col(c)
    out = c
    for bound, pick in ((low, F.greatest), (high, F.least)):
        if bound is not None:
            out = pick(out, bound if isinstance(bound, Column) else F.lit(float(bound)))
    return F.when(c.isNotNull(), out)


def round_step(c: Column | str, step: float) -> Column:
    """The nearest multiple of step, halves to even."""
    return F.rint(col(c) / F.lit(float(step))) * F.lit(float(step))


def weighted_mean(x: Column | str, w: Column | str) -> Column:
    """Over rows with both present; null where the weights sum to zero."""
    x, w = col(x).cast("double"), col(w).cast("double")
    both = x.isNotNull() & w.isNotNull()
    return F.try_divide(F.sum(F.when(both, x * w)), F.sum(F.when(both, w)))


def divide(a: Column | str, b: Column | str) -> Column:
    """a / b in doubles as numpy and SQL engines divide: by zero it is an infinity of the signs' product, 0 / 0 is NaN."""
    a, b = col(a).cast("double"), col(b).cast("double")
    return F.coalesce(F.try_divide(a, b), a * F.pow(b, F.lit(-1.0)))


def all_of(conditions) -> Column:
    return functools.reduce(operator.and_, conditions, F.lit(True))
