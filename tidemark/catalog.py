"""All queries of the engine with their SQL."""

from __future__ import annotations

from .plans import extras, frames, measures, stored
from .plans.registry import QUERIES, SQL

_LOADED = (extras, frames, measures, stored)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
