"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from tools.check import TABLES, frame
from wayfare.plans.catalog import all_queries

QUERIES = all_queries()


@pytest.fixture(scope="module")
def base(small):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{small}/{table}.parquet')")
    return con


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.oracle])
def test_matches_sql(spark, small, base, name):
    q = QUERIES[name]
    df = q.plan(spark, small)
    got = frame(df.columns, df.collect())
    cursor = base.execute(q.oracle)
    want = frame([d[0] for d in cursor.description], cursor.fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["id", "current_state", "p"]
