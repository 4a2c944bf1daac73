"""Number and term-name texts, JSON and column-level encryption."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import col, finite, is_missing


def number_format(c: Column | str, decimals: int = 2, commas: bool = True, percent: bool = False, missing: str = "") -> Column:
    """Fixed decimals, optional thousands separators and percent sign."""
    c = col(c).cast("double")
    scaled = c * 100 if percent else c
    text = F.format_number(scaled, decimals) if commas else F.format_string(f"%.{decimals}f", scaled)
    return F.when(is_missing(c), F.lit(missing)).otherwise(F.concat(text, F.lit("%")) if percent else text)


def _fixed(x: Column, d: int) -> Column:
    """%.{d}f as C and Python print it: the number's exact value, halves to even. (format_string rounds the shortest decimal
    text, halves up.)"""
    return F.replace(F.format_number(x, d), F.lit(","), F.lit(""))


def _scientific(x: Column, d: int) -> Column:
    """%.{d}e, rounded in the same way."""
    text = F.call_function("format_number", x, F.lit("0." + "0" * d + "E00"))
    return F.replace(F.replace(text, F.lit("E-"), F.lit("e-")), F.lit("E"), F.lit("e+"))


def _whole(x: Column) -> Column:
    """A whole number under 2^126 with commas, all digits exact: in one long, or in two put together as a decimal."""
    base = F.lit(float(2**63))
    high = F.floor(F.abs(x) / base)
    digits = high.cast("decimal(19,0)") * F.lit(str(2**63)).cast("decimal(19,0)") + (F.abs(x) - high * base).cast("long").cast("decimal(19,0)")
    return F.when(F.abs(x) < base, F.format_number(x.cast("long"), 0)).otherwise(F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), F.format_number(digits, 0)))


def adaptive_number(c: Column | str) -> Column:
    """Whole numbers (under 2^126) with commas; within 1e-4..1e6 two or four decimals if those are right to a thousandth; else scientific."""
    x = col(c).cast("double")
    size = F.abs(x)
    close = lambda d: F.abs(F.round(x, d) - x) <= size * 1e-3
    mid = (size >= 1e-4) & (size < 1e6)
    return (
        F.when(is_missing(x), F.lit(""))
        .when((x == F.rint(x)) & (size < 2.0**126), _whole(x))
        .when(mid & close(2), _fixed(x, 2))
        .when(mid & close(4), _fixed(x, 4))
        .otherwise(_scientific(x, 2))
    )


def human_number(c: Column | str, decimals: int = 2) -> Column:
    """K, M, B and T suffixes, scientific below 0.01, trailing zeros cut."""
    x = col(c).cast("double")
    size = F.abs(x)
    cut = lambda t: F.regexp_replace(F.regexp_replace(t, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    fixed = lambda v: cut(F.format_string(f"%.{decimals}f", v))
    out = F.when(is_missing(x), F.lit("")).when(x == 0, F.lit("0")).when(size < 0.01, F.format_string(f"%.{decimals}e", x))
    for limit, unit, mark in ((1e3, 1.0, ""), (1e6, 1e3, "K"), (1e9, 1e6, "M"), (1e12, 1e9, "B")):
        out = out.when(size < limit, F.concat(fixed(x / unit), F.lit(mark)))
    return out.otherwise(F.concat(fixed(x / 1e12), F.lit("T")))


def number_texts(c: Column | str) -> Column:
    """adaptive_number of each element."""
    return F.transform(col(c), adaptive_number)


def term_name(kind: str, *features: str, by: str | None = None, level: Column | str | None = None) -> Column:
    """kind__feature[__feature][__by__level]."""
    parts = [F.lit(kind), *map(F.lit, features)]
    if by is not None:
        parts += [F.lit("by"), F.lit(by)] if level is None else [F.lit("by"), F.lit(by), col(level).cast("string")]
    return F.concat_ws("__", *parts)


def parse_term(c: Column | str) -> Column:
    """struct(kind, features, by, level) of a term name."""
    p = F.split(col(c), "__")
    at = F.array_position(p, "by")
    n = F.size(p)
    names = F.when(at > 0, F.slice(p, 2, F.greatest(at - 2, F.lit(0)).cast("int"))).otherwise(F.slice(p, 2, F.greatest(n - 1, F.lit(0))))
    return F.struct(p[0].alias("kind"), names.alias("features"), F.when(at > 0, F.get(p, at.cast("int"))).alias("by"), F.when(at > 0, F.get(p, (at + 1).cast("int"))).alias("level"))


def to_json(*columns: str) -> Column:
    """One JSON object; NaN and infinities become null, dates ISO text."""
    return F.to_json(F.struct(*[col(c) for c in columns]), {"ignoreNullFields": "false"})


def json_safe(c: Column | str) -> Column:
    return finite(c)


def strict_number(c: Column | str) -> Column:
    """The number itself; an error where it is NaN or infinite."""
    c = col(c)
    return F.when(c.isNotNull() & is_missing(c), F.raise_error(F.lit("number is not finite")).cast("double")).otherwise(c)


def encrypt(c: Column | str, key: Column | str) -> Column:
    """AES-GCM, a random nonce in front."""
    return F.base64(F.aes_encrypt(col(c).cast("binary"), col(key).cast("binary"), F.lit("GCM")))


def decrypt(c: Column | str, key: Column | str) -> Column:
    return F.aes_decrypt(F.unbase64(col(c)), col(key).cast("binary"), F.lit("GCM")).cast("string")
