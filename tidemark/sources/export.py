"""Report sinks for small results: column schemas, HTML tables and pages, CSV sheets."""

from __future__ import annotations

import html
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    title: str | None = None
    format: str | None = None  # number, percent, integer, date, human
    decimals: int = 2
    transform: Callable[[Column], Column] | None = None

    def column(self) -> Column:
        c = F.col(self.name)
        c = self.transform(c) if self.transform else c
        if self.format in ("number", "percent", "integer"):
            c = text.number_format(c, 0 if self.format == "integer" else self.decimals, True, self.format == "percent")
        elif self.format == "human":
            c = text.human_number(c, self.decimals)
        elif self.format == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        return c.alias(self.title or self.name)


@dataclass
class ColumnSchema:
    """Renames, formats and the order of display."""

    specs: Sequence[ColumnSpec]

    def where(self, keep: Callable[[ColumnSpec], bool]) -> ColumnSchema:
        return ColumnSchema([s for s in self.specs if keep(s)])

    def apply(self, df: DataFrame) -> DataFrame:
        names = [s.name for s in self.specs]
        if len(set(names)) < len(names):
            raise ValueError("a column appears twice")
        if unknown := [n for n in names if n not in df.columns]:
            raise ValueError(f"unknown columns: {unknown}")
        return df.select(*[s.column() for s in self.specs])


def html_rows(df: DataFrame) -> Column:
    """One table row of escaped cells."""
    cells = []
    for c in df.columns:
        v = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            v = F.replace(v, F.lit(raw), F.lit(safe))
        cells.append(F.concat(F.lit("<td>"), v, F.lit("</td>")))
    return F.concat(F.lit("<tr>"), *cells, F.lit("</tr>"))


def html_table(df: DataFrame, most: int = 10_000) -> str:
    """A report table; more than most rows are an error, since a page is built on the driver."""
    rows = [r[0] for r in df.select(html_rows(df)).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{''.join(rows)}</tbody></table>"


@dataclass
class HtmlPage:
    title: str
    parts: list[str] = field(default_factory=list)

    def heading(self, words: str, level: int = 2) -> HtmlPage:
        self.parts.append(f"<h{level}>{html.escape(words)}</h{level}>")
        return self

    def table(self, df: DataFrame) -> HtmlPage:
        self.parts.append(html_table(df))
        return self

    def render(self) -> str:
        return f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>{html.escape(self.title)}</title></head><body>{''.join(self.parts)}</body></html>"


def write_sheets(path: str, sheets: dict[str, DataFrame], schemas: dict[str, ColumnSchema] | None = None) -> None:
    """One folder of CSV files per sheet, formatted by its schema."""
    for name, df in sheets.items():
        shown = (schemas or {}).get(name)
        (shown.apply(df) if shown else df).coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{path}/{name}")
