"""Every query with SQL against DuckDB on the smallest tables; every other one runs."""

import math
import os

import duckdb
import pytest

from tests.conftest import SF
from tidemark import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return float(v) if type(v).__name__ == "Decimal" else v


def near(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)
    return a == b


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is not None, str(type(x)) if not isinstance(x, (int, float)) else "", round(x, 3) if isinstance(x, float) else x) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    a, mine = table(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(catalog.oracle_sql()[name])
    b, theirs = table([d[0] for d in cur.description], cur.fetchall())
    assert a == b
    assert len(mine) == len(theirs)
    for x, y in zip(mine, theirs, strict=True):
        assert all(near(p, q) for p, q in zip(x, y, strict=True)), (x, y)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    df = catalog.queries()[name](spark, SF)
    assert df.columns and df.count() > 0
