"""Totals of microseconds beyond 64 bits: queries over orders that are hundreds of years apart."""

from __future__ import annotations

import duckdb
import pytest

from tools.check import frame
from wayfare.plans.catalog import all_queries

QUERIES = [
    "timeout_score",
    "timeout_absorption",
    "laplace_generator",
    "stratified_generator",
    "stratified_score",
    "piecewise_generator",
    "piecewise_score",
    "bin_summary",
]


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    """500 customers with 12 orders each between 1600 and 9500; the last customer's come later, so the others are resolved."""
    folder = tmp_path_factory.mktemp("far")
    con = duckdb.connect()
    con.execute(
        f"""CREATE TABLE orders AS
SELECT c * 100 + i AS o_orderkey, c AS o_custkey, CASE WHEN hash(c, i) % 5 < 2 THEN 'F' ELSE 'O' END AS o_orderstatus,
  ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][1 + (hash(i, c, 7) % 5)::INT] AS o_orderpriority,
  TIMESTAMP '1600-01-01' + to_days((i * 240000 + hash(c, i, 3) % 90000 + (c % 50 = 0)::INT * 300000)::INT) AS o_orderdate
FROM range(500) t(c), range(12) u(i);
COPY orders TO '{folder}/orders.parquet'"""
    )
    return str(folder), con


@pytest.mark.parametrize("name", QUERIES)
def test_totals_beyond_64_bits(spark, far, name):
    folder, con = far
    query = all_queries()[name]
    # The SQL's own 64-bit totals overflow here; with 128 bits it says what is right.
    cursor = con.execute(query.oracle.replace("::BIGINT", "::HUGEINT"))
    want = frame([d[0] for d in cursor.description], cursor.fetchall())
    df = query.plan(spark, folder)
    assert frame(df.columns, df.collect()) == want
