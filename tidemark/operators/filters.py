"""Filters, tags, projections, column hygiene and sampling."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import nulls
from .binning import quantiles

_COMPARE = {
    "==": lambda c, v: c == v,
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
    "!=": nulls.ne,
    "in": lambda c, v: c.isin(list(v)),
    "not in": nulls.not_in,
    "between": lambda c, v: c.between(v[0], v[1]),
    "isnull": lambda c, v: c.isNull(),
    "notnull": lambda c, v: c.isNotNull(),
    "f": lambda c, v: v(c),
}
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class Criteria:
    """A condition on one column, as a tuple and as text."""

    column: str
    op: str
    value: object = None

    @property
    def as_tuple(self) -> tuple:
        return self.column, self.op, self.value

    def __str__(self) -> str:
        return f"{self.column} {self.op}" if self.value is None else f"{self.column} {self.op} {self.value}"


def condition(df: DataFrame, column: str, op: str, value=None) -> Column:
    """One predicate; an unknown column or operator is an error. Texts compared with date columns are parsed."""
    if column not in df.columns:
        raise KeyError(column)
    if op not in _COMPARE:
        raise ValueError(f"unknown operator {op!r}")
    kind = df.schema[column].dataType
    if isinstance(kind, _TIMES):
        parse = lambda v: F.lit(v).cast(kind) if isinstance(v, str) else v
        value = [parse(v) for v in value] if isinstance(value, (list, tuple)) else parse(value)
        if op in ("in", "not in"):
            c = F.col(column)
            hit = c.isin(*value)
            return hit if op == "in" else F.coalesce(~hit, F.lit(True))
        if op == "!=":
            return ~F.col(column).eqNullSafe(value if isinstance(value, Column) else F.lit(value))
    return _COMPARE[op](F.col(column), value)


def _flat(filters: Iterable) -> list[Criteria]:
    out: list[Criteria] = []
    for f in filters:
        if isinstance(f, Criteria):
            out.append(f)
        elif f and isinstance(f[0], str):
            out.append(Criteria(*f))
        else:
            out += _flat(f)
    return out


def predicate(df: DataFrame, filters: Iterable) -> Column:
    """All conditions; nested lists are joined by AND too."""
    return nulls.all_of([condition(df, *c.as_tuple) for c in _flat(filters)])


def order_keys(sort_by, ascending=True) -> list[Column]:
    """Sort keys with missing values last."""
    names = [sort_by] if isinstance(sort_by, str) else list(sort_by)
    ways = [ascending] * len(names) if isinstance(ascending, bool) else list(ascending)
    return [F.col(n).asc_nulls_last() if up else F.col(n).desc_nulls_last() for n, up in zip(names, ways, strict=True)]


def filter_frame(df: DataFrame, filters: Iterable = (), sort_by=None, ascending=True) -> DataFrame:
    """Filter by condition tuples, then sort."""
    df = df.filter(predicate(df, filters))
    return df if sort_by is None else df.orderBy(*order_keys(sort_by, ascending))


def tag_rows(df: DataFrame, rules: Iterable, flag: str = "_scorable", reason: str = "_skip_reason") -> DataFrame:
    """Marks rows instead of dropping them: flag, and the failed rules' texts. Rules on absent columns are passed over."""
    present = [c for c in _flat(rules) if c.column in df.columns]
    fails = [F.when(~nulls.holds(condition(df, *c.as_tuple)), F.lit(str(c))) for c in present]
    out = df.withColumn(reason, F.concat_ws(", ", *fails) if fails else F.lit(""))
    return out.withColumn(flag, F.col(reason) == "")


@dataclass(frozen=True)
class Clip:
    """Bounds of a column: fixed, or learnt as exact linear quantiles."""

    column: str
    lower: float | None = None
    upper: float | None = None
    lower_q: float | None = None
    upper_q: float | None = None
    output: str | None = None


def learn_clips(df: DataFrame, rules: Sequence[Clip]) -> list[Clip]:
    """Rules with their quantiles replaced by bounds."""
    wanted = [(i, side, q) for i, r in enumerate(rules) for side, q in (("lower", r.lower_q), ("upper", r.upper_q)) if q is not None]
    if not wanted:
        return list(rules)
    got: dict = {}
    for c in dict.fromkeys(rules[i].column for i, _, _ in wanted):
        mine = [(i, side, q) for i, side, q in wanted if rules[i].column == c]
        got |= {(i, side): v for (i, side, _), v in zip(mine, quantiles(df, c, [q for _, _, q in mine]), strict=False)}
    return [Clip(r.column, got.get((i, "lower"), r.lower), got.get((i, "upper"), r.upper), None, None, r.output) for i, r in enumerate(rules)]


def apply_clips(df: DataFrame, rules: Sequence[Clip]) -> DataFrame:
    return df.withColumns({r.output or r.column: nulls.clip(r.column, r.lower, r.upper) for r in rules})


@dataclass(frozen=True)
class Category:
    """A column's values mapped to names, and the names' places in a fixed order as {output}_idx."""

    column: str
    output: str
    order: Sequence[str]
    mapping: dict | Callable[[Column], Column] | None = None


def map_categories(df: DataFrame, maps: Sequence[Category]) -> DataFrame:
    for m in maps:
        c = F.col(m.column)
        if callable(m.mapping):
            name = m.mapping(c)
        elif m.mapping:
            name = F.create_map(*[F.lit(x) for kv in m.mapping.items() for x in kv])[c]
        else:
            name = c.cast("string")
        place = F.array_position(F.array(*map(F.lit, m.order)), name)
        df = df.withColumn(m.output, name).withColumn(f"{m.output}_idx", F.when(place > 0, place - 1))
    return df


@dataclass
class Preprocessor:
    """Derive, filter, clip, map; quantile bounds are learnt on the filtered rows. transform doesn't filter."""

    derived: dict[str, Callable[[DataFrame], Column]] = field(default_factory=dict)
    filters: Sequence = ()
    clips: Sequence[Clip] = ()
    categories: Sequence[Category] = ()
    learnt: list[Clip] | None = None

    def _derive(self, df: DataFrame) -> DataFrame:
        for name, make in self.derived.items():
            df = df.withColumn(name, make(df))
        return df

    def fit_transform(self, df: DataFrame) -> DataFrame:
        df = filter_frame(self._derive(df), self.filters)
        self.learnt = learn_clips(df, self.clips)
        return map_categories(apply_clips(df, self.learnt), self.categories)

    def transform(self, df: DataFrame) -> DataFrame:
        if self.learnt is None:
            raise ValueError("fit first")
        return map_categories(apply_clips(self._derive(df), self.learnt), self.categories)

    def check(self, df: DataFrame) -> DataFrame:
        return tag_rows(self._derive(df), self.filters)


@dataclass(frozen=True)
class FeatureRule:
    """Input columns to named outputs."""

    inputs: Sequence[str]
    outputs: Sequence[str]
    make: Callable[..., Column | Sequence[Column]]


def generate_features(df: DataFrame, rules: Sequence[FeatureRule]) -> DataFrame:
    for r in rules:
        made = r.make(*map(F.col, r.inputs))
        made = [made] if isinstance(made, Column) else list(made)
        if len(made) != len(r.outputs):
            raise ValueError(f"{len(made)} columns for {len(r.outputs)} names")
        df = df.withColumns(dict(zip(r.outputs, made, strict=True)))
    return df


def drop_aliases(df: DataFrame, groups: Iterable[Sequence[str]], keep: str = "first") -> DataFrame:
    """Of each group's columns that exist, keep the first or last named."""
    gone: list[str] = []
    for g in groups:
        have = [c for c in g if c in df.columns]
        gone += have[1:] if keep == "first" else have[:-1]
    return df.drop(*gone)


def duplicate_columns(df: DataFrame) -> list[str]:
    """Second and later appearances."""
    seen: set[str] = set()
    return [c for c in df.columns if c in seen or seen.add(c)]


def drop_duplicate_columns(df: DataFrame, keep: str = "first", only: Iterable[str] | None = None) -> DataFrame:
    """By place, so that equal names don't matter."""
    names, chosen = df.columns, None if only is None else set(only)
    span = range(len(names)) if keep == "first" else range(len(names) - 1, -1, -1)
    seen: set[str] = set()
    kept = sorted(i for i in span if (chosen is not None and names[i] not in chosen) or not (names[i] in seen or seen.add(names[i])))
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.select(*[f"c{i}" for i in kept]).toDF(*[names[i] for i in kept])


# Names of column types that callers may use.
TYPES = {"float": "double", "int": "long", "string": "string", "bool": "boolean", "date": "date", "datetime": "timestamp", "category": "string"}


def coerce_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Values that don't fit become null; NaN too."""
    out = {}
    for name, kind in types.items():
        c = nulls.clean(name) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else F.col(name)
        out[name] = c.try_cast(TYPES.get(kind.lower(), kind))
    return df.withColumns(out)


def formula_columns(formula: str) -> list[str]:
    """Names used by a model formula such as y ~ s(x, k=5) + te(a, b) + z."""
    import re

    left, _, right = formula.partition("~")
    words = re.findall(r"[A-Za-z_.][\w.]*(?!\w*\()(?!\s*=)", re.sub(r"=\s*[\"'\w.]+", "=", right))
    return list(dict.fromkeys([left.strip(), *[w for w in words if not re.search(rf"{re.escape(w)}\s*[(=]", right)]]))


def select_for_formula(df: DataFrame, formula: str, extra: Iterable[str] = ()) -> DataFrame:
    wanted = dict.fromkeys([*formula_columns(formula), *extra])
    return df.select(*[c for c in df.columns if c in wanted])


def sample_fraction(df: DataFrame, fraction: float, key: str, seed: int = 42) -> DataFrame:
    """The same rows each time, here and in any engine with MD5: those whose key's place falls under the fraction."""
    return df.where(_place(key, seed) < int(fraction * _PLACES))


_PLACES = 1 << 32


def _place(key: str, seed: int) -> Column:
    """The first 32 bits of the MD5 of seed:key, the key as text."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly n rows (or all) by hashed key."""
    return df.orderBy(_place(key, seed), key).limit(n)


def case_control(df: DataFrame, event: Column, rate: float, key: str, seed: int = 42) -> tuple[DataFrame, float]:
    """All events and a hash sample of the others, so that events make up about rate; also the others' sampling weight."""
    row = df.agg(F.sum(F.when(event, 1).otherwise(0)).alias("e"), F.count("*").alias("n")).first()
    events, others = row["e"] or 0, (row["n"] or 0) - (row["e"] or 0)
    weight = min(1.0, events * (1 - rate) / rate / others) if others else 1.0
    return df.where(nulls.holds(event) | (_place(key, seed) < int(weight * _PLACES))), weight
