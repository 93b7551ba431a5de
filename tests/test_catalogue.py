"""Queries against their SQL on the smallest tables."""

import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def _plain(row):
    return tuple(round(v, 6) if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else v for v in row)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = Counter(_plain(tuple(r[names.index(c)] for c in columns)) for r in result.fetchall())
    assert Counter(_plain(r) for r in df.select(*columns).collect()) == want


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(QUERIES)
    assert all(callable(q) for q in QUERIES.values())
