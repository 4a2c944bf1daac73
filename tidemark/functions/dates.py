"""Date parsing and calendar arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import col

# What each directive of a C-style date format is in Spark's patterns.
DIRECTIVES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%y": "yy", "%H": "HH", "%M": "mm", "%S": "ss", "%b": "MMM", "%B": "MMMM", "%j": "DDD"}


def parse_date(c: Column | str, strict: bool = False) -> Column:
    """yyyy-MM-dd, else yyyyMMdd, else null (strict: an error for a text that is no date)."""
    c = col(c)
    out = F.coalesce(F.try_to_date(c, "yyyy-MM-dd"), F.try_to_date(c, "yyyyMMdd"))
    return F.when(c.isNotNull() & out.isNull(), F.raise_error(F.concat(F.lit("not a date: "), c)).cast("date")).otherwise(out) if strict else out


def date_text(c: Column | str, form: str = "%Y-%m-%d") -> Column:
    for a, b in DIRECTIVES.items():
        form = form.replace(a, b)
    return F.date_format(col(c), form)


def midnight(c: Column | str) -> Column:
    return F.date_trunc("day", col(c))


def next_friday(c: Column | str) -> Column:
    """The same day if it is a Friday."""
    return F.next_day(F.date_sub(col(c), 1), "FRI")


def month_end(c: Column | str) -> Column:
    return F.last_day(col(c))


def weeks_between(later: Column | str, earlier: Column | str, how: str = "floor") -> Column:
    days = F.datediff(col(later), col(earlier)) / 7
    return (F.floor(days) if how == "floor" else F.rint(days)).cast("long")


def year_of(c: Column | str) -> Column:
    """Vintage year of a date, timestamp or text."""
    return F.year(col(c).try_cast("date"))


def half_life(days: Column, life: float) -> Column:
    """Weight that halves every life days."""
    import math

    return F.exp(F.lit(-math.log(2)) * days / F.lit(float(life)))
