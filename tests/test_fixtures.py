"""Hand-computed cases on a four-journey log."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from wayfare.functions.columns import age_bin, calibration_bin, sample_count, shift_prevalence
from wayfare.operators import assemble, clean, evaluate, rates, scoring, snapshots, transitions
from wayfare.sources.log import open_log

H = 3600
TIMEOUT = 5_184_000

EVENTS = [
    ("A", "2024-01-01 00:00", "browse", 4),
    ("A", "2024-01-01 01:00", "add", 11),
    ("A", "2024-01-01 01:00", "add", 11),
    ("A", "2024-01-01 03:00", "checkout", 6),
    ("A", "2024-01-01 03:30", "promo", 12),
    ("A", "2024-01-01 05:00", "order_shipped", 28),
    ("B", "2024-01-01 00:00", "browse", 4),
    ("B", "2024-01-01 02:00", "add", 11),
    ("C", "2024-03-01 00:00", "browse", 4),
    ("C", "2024-03-10 00:00", "add", 11),
    ("D", "2024-01-02 00:00", "add", 11),
    ("D", "2024-01-02 01:00", "order_shipped", 28),
    ("D", "2024-01-02 02:00", "browse", 4),
]


@pytest.fixture(scope="module")
def raw(spark):
    df = spark.createDataFrame(EVENTS, "id string, event_timestamp string, event_name string, ed_id long")
    return df.withColumn("event_timestamp", F.to_timestamp("event_timestamp")).repartition(3)


@pytest.fixture(scope="module", params=[2_000_000, 2])
def log(raw, request):
    """Plain, and with every journey of more than two events cut into slices."""
    return open_log(raw, hot_rows=request.param)


def test_duplicates(raw):
    r = clean.duplicate_report(raw).first()
    assert (r.total_rows, r.unique_rows, r.duplicate_rows) == (13, 12, 1)
    assert r.duplicate_share == pytest.approx(1 / 13)
    assert clean.deduplicate(raw).count() == 12


def test_summary_and_labels(log):
    labeled = assemble.labeled_journeys(log)
    got = rows(labeled, "id", "num_actions", "num_unique_actions", "duration_seconds", "first_action", "last_action",
               "has_order_shipped", "journey_status")
    assert got == [
        ("A", 5, 5, 18000, 4, 28, True, "successful"),
        ("B", 2, 2, 7200, 4, 11, False, "incomplete"),
        ("C", 2, 2, 777600, 4, 11, False, "other"),
        ("D", 3, 3, 7200, 11, 4, True, "incomplete"),
    ]
    groups = assemble.label_by_any_success(assemble.journey_summary(log), log.end())
    assert rows(groups, "id", "source_table") == [
        ("A", "complete"), ("B", "incomplete"), ("C", "ongoing"), ("D", "complete")
    ]


def test_transitions(log):
    got = rows(transitions.transitions(log), "id", "state", "next_state", "dt_seconds")
    assert got == sorted([
        ("A", 4, 11, 3600.0), ("A", 11, 6, 7200.0), ("A", 6, 28, 7200.0), ("B", 4, 11, 7200.0),
        ("C", 4, 11, 777600.0), ("D", 11, 28, 3600.0), ("D", 28, 4, 3600.0),
    ], key=repr)


def test_timeout_transitions_and_fit(log):
    table = transitions.timeout_transitions(log)
    got = rows(table, "id", "state", "next_state", "dt_seconds")
    assert got == sorted([
        ("A", 4, 11, 3600.0), ("A", 11, 6, 7200.0), ("A", 6, 28, 7200.0), ("B", 4, 11, 7200.0),
        ("B", 11, -1, float(TIMEOUT)), ("D", 11, 28, 3600.0), ("D", 28, 4, 3600.0), ("D", 4, -1, float(TIMEOUT)),
    ], key=repr)
    totals = scoring.timeout_totals(table)
    fitted = {(r.from_state, r.to_state): r for r in rates.with_rates(totals).collect()}
    assert fitted[4, 11].exposure_us == 5_194_800_000_000
    assert fitted[11, 6].exposure_us == 5_194_800_000_000
    assert fitted[6, 28].exposure_us == 7_200_000_000
    assert fitted[4, 11].rate == pytest.approx(3.85000385e-07)
    assert fitted[6, 28].rate == pytest.approx(1.38888889e-04)
    p = {r.state: r.p for r in scoring.timeout_table(totals).collect()}
    assert p == pytest.approx({4: 4 / 9, 11: 2 / 3, 6: 1.0, 28: 1.0, -1: 0.0})
    assert rates.terminal_share(totals).first().fallback == 0.5
    weights = scoring.fitted_weights(table)
    v = {r.state: r.p for r in scoring.semi_markov_table(weights).collect()}
    assert v[4] == pytest.approx(4 / 9) and v[11] == pytest.approx(2 / 3)


def test_suffix(log, spark):
    shots = spark.createDataFrame(
        [("A", "A::1", "2024-01-01 01:00"), ("B", "B::1", "2024-01-01 00:00")], "id string, snapshot_id string, t string"
    ).select("id", "snapshot_id", F.unix_micros(F.to_timestamp("t")).alias("snapshot_us"))
    got = rows(transitions.suffix_transitions(log, shots), "snapshot_id", "seq", "state", "next_state", "dt_seconds")
    assert [g[:1] + g[2:] for g in got] == [
        ("A::1", 11, 6, 7200.0), ("A::1", 6, 28, 7200.0), ("B::1", 4, 11, 7200.0), ("B::1", 11, -1, float(TIMEOUT))
    ]


def test_age_bins(log):
    table = transitions.timeout_transitions(log).where("id = 'B'")
    split = transitions.age_bin_exposure(table, (86400, 604800, 2592000, 5184000))
    got = rows(split, "state", "next_state", "bin", "exposure_us", "jumps")
    us = 1_000_000
    assert got == sorted([
        (4, 11, 0, 7200 * us, 1), (11, -1, 0, 79200 * us, 0), (11, -1, 1, 518400 * us, 0), (11, -1, 2, 1987200 * us, 0),
        (11, -1, 3, 2592000 * us, 0), (11, -1, 4, 7200 * us, 1),
    ], key=repr)


def test_small_expressions(spark):
    one = spark.range(1)
    row = one.select(
        snapshots.fraction_cut(F.lit(1)).alias("a"), snapshots.fraction_cut(F.lit(2)).alias("b"),
        snapshots.fraction_cut(F.lit(5)).alias("c"), snapshots.fraction_cut(F.lit(10)).alias("d"),
    ).first()
    assert tuple(row) == (1, 1, 3, 7)
    edges = (86400, 604800)
    assert tuple(one.select(age_bin(F.lit(86399), edges), age_bin(F.lit(86400), edges)).first()) == (0, 1)
    values = [calibration_bin(F.lit(p)).alias(f"c{i}") for i, p in enumerate((0.0, 0.1, 0.100001, 1.0))]
    assert tuple(one.select(*values).first()) == (1, 1, 2, 10)
    shifted = one.select(*[shift_prevalence(F.lit(p)).alias(f"s{i}") for i, p in enumerate((0.1, 0.5, 0.9))]).first()
    assert tuple(shifted) == pytest.approx((0.020458, 0.158226, 0.628488), abs=1e-6)
    day = 86_400_000_000
    spans = (0, 1_000_000, day, day + 1_000_000, 400 * day)
    counts = one.select(*[sample_count(F.lit(s), 60).alias(f"n{i}") for i, s in enumerate(spans)]).first()
    assert tuple(counts) == (1, 1, 1, 2, 60)


def _log(spark, ids, hot):
    data = [("x", i, f"n{e}", e) for i, e in enumerate(ids)]
    df = spark.createDataFrame(data, "id string, t long, event_name string, ed_id long")
    return open_log(df.select("id", F.timestamp_seconds("t").alias("event_timestamp"), "event_name", "ed_id"), hot_rows=hot)


@pytest.mark.parametrize("hot", [1_000, 1])
@pytest.mark.parametrize(
    ("ids", "entropy", "repeat"), [([4, 11, 6, 12], 2.0, 1), ([4, 4, 11], 0.918296, 2), ([4], 0.0, 1)]
)
def test_entropy_and_repeat(spark, ids, entropy, repeat, hot):
    out = snapshots.open_tabular(_log(spark, ids, hot), []).first()
    assert out.action_entropy == pytest.approx(entropy, abs=1e-6)
    assert out.max_action_repeat == repeat


def test_histories_and_last_events(spark):
    last = transitions.order_k_history(_log(spark, [4, 11, 28], 1_000), 2, states=None)
    assert [list(r.history) for r in last.orderBy("seq").collect()] == [[-999, 4], [4, 11], [28, 28]]
    shot = snapshots.open_snapshots(_log(spark, [1, 2], 1_000), [], success_event="none").first()
    assert [shot[f"last{i}_event"] for i in range(1, 6)] == ["n2", "n1", "missing", "missing", "missing"]


def test_metrics(spark):
    df = spark.createDataFrame(
        list(zip([1, 0, 1, 0, 1], [0.9, 0.6, 0.6, 0.2, 0.4])), "label int, p double"
    ).withColumn("model", F.lit("m")).repartition(3)
    r = evaluate.all_metrics(df).first()
    assert r.roc_auc == pytest.approx(0.75)
    assert r.average_precision == pytest.approx(0.805556, abs=1e-6)
    assert r.brier_score == pytest.approx(0.186)
    assert r.log_loss == pytest.approx(0.534382, abs=1e-6)
