"""Spread of the gaps of a journey: exact for long gaps that differ by microseconds, also where the journey is cut into slices."""

from __future__ import annotations

import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F

from wayfare.operators import snapshots
from wayfare.sources.log import open_log


@pytest.mark.parametrize("hot_rows", [None, 8])
def test_close_long_gaps(spark, hot_rows):
    gaps = [400 * 86_400_000_000 + (i % 3) for i in range(20)]
    start = dt.datetime(1990, 1, 1)
    times = [start + dt.timedelta(microseconds=sum(gaps[:i])) for i in range(len(gaps) + 1)]
    events = spark.createDataFrame([("a", t, "x", 1) for t in times] + [("b", start, "x", 1)], "id string, event_timestamp timestamp, event_name string, ed_id int")
    log = open_log(events, **({"hot_rows": hot_rows} if hot_rows else {}))
    rows = snapshots.prefix_rows(log).select("id", *snapshots.event_columns([], F.col("_first.ts_us"), ()))
    got = {r.num_events: r.std_gap_days * 86_400e6 for r in rows.where("id = 'a'").collect()}
    want = {n: statistics.pstdev(gaps[: n - 1]) if n > 2 else 0.0 for n in range(1, len(times) + 1)}
    assert got == pytest.approx(want, rel=1e-9, abs=1e-9)
    assert rows.where("id = 'b'").first().std_gap_days == 0
