"""Journeys cut into slices give the same answers as plain windows."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from wayfare.functions.ordered import (
    along,
    following,
    later_min,
    latest,
    nth,
    previous,
    recent,
    running_max,
    running_sum,
    total_max,
    total_min,
    total_sum,
)
from wayfare.operators import assemble, clean, snapshots, transitions
from wayfare.sources import adapters
from wayfare.sources.log import open_log

DAY = 86_400


@pytest.fixture(scope="module")
def logs(spark, small):
    plain = adapters.events_log(spark, small)
    sliced = adapters.events_log(spark, small, hot_rows=40)
    assert plain.hot is None and sliced.hot is not None
    assert sliced.events.where("slice IS NOT NULL").count() > 0
    return plain, sliced


def same(build, logs, *columns):
    a, b = (rows(build(log), *columns) for log in logs)
    assert a and a == b


def test_every_step(logs):
    odd = F.when(F.col("ed_id") == 12, F.col("ts_us"))
    steps = {
        "nth": nth(),
        "sum": running_sum(F.col("ed_id")),
        "max": running_max(F.col("ed_id")),
        "prev": previous(odd),
        "next": following(odd),
        "latest": latest(odd),
        "later": later_min(odd),
        "recent": recent(F.col("event_name"), 4),
        "tsum": total_sum(F.col("ed_id")),
        "tmax": total_max(odd),
        "tmin": total_min(odd),
    }
    same(lambda log: along(log.events, steps).drop("slice"), logs)


def test_part_of_a_log(logs):
    keep = ("id", "event_name", "ed_id", "ts_us")
    same(lambda log: log.of(log.events.where("ed_id = 4").select("id").distinct()).events, logs, *keep)
    hot = logs[1].hot.select("id")
    same(lambda log: log.of(hot).events, logs, *keep)
    assert logs[1].of(hot).events.where("slice IS NULL").count() == 0


def test_burst_is_cut_evenly(spark):
    start = 1_700_000_000_000_000
    times = [start - 10 * 365 * DAY * 1_000_000, *(start + 15_000 * i for i in range(4_000))]
    rows = spark.createDataFrame([("a", t, "view", 4) for t in times] + [("b", start, "view", 4)], "id string, t long, event_name string, ed_id long")
    log = open_log(rows.select("id", F.timestamp_micros("t").alias("event_timestamp"), "event_name", "ed_id"), hot_rows=1_000)
    sizes = [r["count"] for r in log.events.where("slice IS NOT NULL").groupBy("id", "slice").count().collect()]
    assert sum(sizes) == len(times) and len(sizes) > 50 and max(sizes) < 200


def test_journeys_and_gaps(logs):
    same(lambda log: clean.renumber_steps(log).drop("slice"), logs)
    same(clean.interevent_gaps, logs)
    same(lambda log: assemble.journey_summary(log), logs)
    same(lambda log: assemble.journey_parts(log, 7).select("id", "part", F.col("journey.ed_id").cast("string").alias("j")), logs)


def test_transition_tables(logs):
    keep = ("id", "seq", "state", "next_state", "dt_us")
    same(transitions.transitions, logs, *keep)
    same(lambda log: transitions.timeout_transitions(log, timeout_seconds=DAY, horizon_seconds=DAY // 2), logs, *keep)
    same(lambda log: transitions.prefix_transitions(log, snapshots.fraction_cut(F.col("n"))), logs, *keep)
    same(lambda log: transitions.order_k_transitions(log, 3), logs, *keep)
    edges = (DAY, 7 * DAY)
    same(lambda log: transitions.age_bin_exposure(transitions.transitions(log), edges), logs)


def probes(log):
    spans = log.events.groupBy("id").agg(F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"))
    shares = F.explode(F.array(*[F.lit(x) for x in (0.0, 0.3, 0.77, 1.0)]))
    out = spans.withColumn("share", shares).withColumn("sample_num", (F.col("share") * 100).cast("int"))
    at = (F.col("lo") + F.floor(F.col("share") * (F.col("hi") - F.col("lo")))).cast("long")
    return out.select("id", "sample_num", at.alias("probe_us"), F.concat_ws("::", "id", "sample_num").alias("snapshot_id"))


def test_lookups_and_suffixes(logs):
    same(lambda log: transitions.state_at(log, probes(log)), logs)
    same(
        lambda log: transitions.suffix_transitions(
            log, probes(log).withColumnRenamed("probe_us", "snapshot_us"), timeout_seconds=DAY
        ),
        logs,
        "snapshot_id",
        "seq",
        "state",
        "next_state",
        "dt_us",
    )


def test_snapshots(logs):
    horizon = DAY // 2

    def realistic(log):
        return snapshots.realistic_snapshots(
            log, ["view", "click"], success_event="purchase", horizon_seconds=horizon
        )

    def timed(log):
        return snapshots.time_snapshots(log, actions=[4, 12], horizon_seconds=horizon)

    same(realistic, logs)
    same(timed, logs)
    same(lambda log: snapshots.open_snapshots(log, ["view"], success_event="purchase"), logs)
    same(lambda log: snapshots.position_snapshots(log, snapshots.random_cut(F.col("n")), horizon_seconds=DAY // 2), logs)


def test_suffix_totals_equal_the_walks(logs):
    def taken(log):
        found = log.events.where("ed_id <> 28").select("id", F.timestamp_micros("ts_us").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
        part = found.where(F.pmod(F.xxhash64("id", "t", "k"), F.lit(9)) == 0)
        name = F.concat_ws("::", "id", F.unix_micros("t").cast("string"), F.col("k").cast("string"))
        return part.select("id", name.alias("snapshot_id"), (F.unix_micros("t") + F.col("k") * 3_600_000_000).alias("snapshot_us"), F.col("k").cast("string").alias("segment"))

    def counted(log):
        walks = transitions.suffix_transitions(log, taken(log), timeout_seconds=DAY).join(taken(log).select("snapshot_id", "segment"), "snapshot_id")
        return walks.groupBy("segment", F.col("state").alias("from_state"), F.col("next_state").alias("to_state")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("dt_us").alias("dwell_us")
        )

    def totals(log):
        return transitions.suffix_totals(log, taken(log), segments=["0", "1", "2"], timeout_seconds=DAY)

    same(totals, logs)
    assert rows(totals(logs[0])) == rows(counted(logs[0]))
    # A segment that is not named is left out.
    part = transitions.suffix_totals(logs[0], taken(logs[0]), segments=["1"], timeout_seconds=DAY)
    assert rows(part) == rows(counted(logs[0]).where("segment = '1'"))


def test_hot_journey_without_an_id_or_event_ids(spark):
    """Rows without an id are one journey, cut like another; events without an id are counted over all slices."""
    events = spark.createDataFrame(
        [(who, i // 2, "x" if i % 3 else None, None if i % 4 == 0 else i % 3) for who in (None, "a") for i in range(60)], "id string, at long, event_name string, ed_id long"
    ).withColumn("event_timestamp", F.timestamp_seconds("at"))
    logs = open_log(events), open_log(events, hot_rows=10)
    assert logs[1].events.where("id IS NULL").select("slice").distinct().count() > 2
    found = []
    for log in logs:
        occ = along(log.events, {"occ": nth()}, key=("id", "ed_id"))
        occ = along(occ, {"place": nth(), "seen": running_sum(F.col("occ")), "before": previous(F.col("ed_id"))})
        found.append(sorted((tuple(r) for r in occ.select("id", "ts_us", "event_name", "ed_id", "occ", "place", "seen", "before").collect()), key=str))
    assert found[0] == found[1] and len(found[0]) == len(found[1])
