"""Run registered queries and compare them with their SQL oracles.

usage: python tools/check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from wayfare.plans.catalog import all_queries  # noqa: E402
from wayfare.session import local_session, release_settled  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return value + 0.0
    if hasattr(value, "item"):
        return value.item()
    return value


def frame(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(body, key=lambda r: tuple((v is not None, str(type(v)), v) if not isinstance(v, (int, float)) or isinstance(v, bool) else (True, "n", v) for v in r))


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session(8)
    base = duckdb.connect()
    for table in TABLES:
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{args.sf}/{table}.parquet')")
    found = all_queries()
    bad = 0
    for name in args.names or list(found):
        q = found[name]
        started = time.time()
        try:
            df = q.plan(spark, args.sf)
            got = df.collect()
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: spark: {str(error)[:1500]}", flush=True)
            continue
        took = time.time() - started
        release_settled(spark)
        if q.oracle is None:
            print(f"rows  {name}: {len(got)} rows {took:.2f}s", flush=True)
            continue
        try:
            started = time.time()
            cursor = base.execute(q.oracle)
            names = [d[0] for d in cursor.description]
            want = cursor.fetchall()
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: oracle: {str(error)[:800]}", flush=True)
            continue
        c1, r1 = frame(df.columns, got)
        c2, r2 = frame(names, want)
        if c1 != c2:
            bad += 1
            print(f"FAIL  {name}: columns {c1} / {c2}", flush=True)
        elif r1 != r2:
            bad += 1
            diff = [(a, b) for a, b in zip(r1, r2) if a != b][:3]
            print(f"FAIL  {name}: rows {len(r1)}/{len(r2)} {c1}\n   {diff}", flush=True)
        else:
            print(f"ok    {name}: {len(r1)} rows {took:.2f}s (sql {time.time() - started:.2f}s)", flush=True)
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
