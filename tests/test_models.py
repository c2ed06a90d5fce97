"""Invariants of the fitted chains, kernels and learners."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayfare.functions import chains
from wayfare.operators import assemble, encode, evaluate, learn, neighbours, rates, scoring, segments, snapshots, transitions
from wayfare.plans.catalog_evaluation import scored
from wayfare.session import settle
from wayfare.sources import adapters

DAY = 86_400


@pytest.fixture(scope="module")
def table(spark, small):
    return settle(transitions.transitions(adapters.events_log(spark, small)))


@pytest.fixture(scope="module")
def failing(spark, small):
    log = adapters.events_log(spark, small)
    return settle(transitions.timeout_transitions(log, timeout_seconds=DAY, horizon_seconds=DAY // 2))


def random_rates(seed, n):
    r = np.random.default_rng(seed)
    q = r.exponential(size=(n, n)) * 10.0 ** r.integers(-3, 3, size=(n, 1))
    np.fill_diagonal(q, 0)
    np.fill_diagonal(q, -q.sum(axis=1))
    return q


@given(st.integers(0, 10_000), st.integers(2, 8), st.floats(0.001, 50))
@settings(max_examples=40, deadline=None)
def test_transition_matrix_matches_eigen_form(seed, n, t):
    q = random_rates(seed, n)
    p = chains.transition_matrix(q, t)
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()
    half = chains.transition_matrix(q, t / 2)
    assert np.allclose(half @ half, p, atol=1e-9)
    values, vectors = np.linalg.eig(q)
    exact = (vectors * np.exp(values * t)) @ np.linalg.inv(vectors)
    assert np.allclose(exact.real, p, atol=1e-6)


@given(st.integers(0, 10_000), st.integers(2, 6))
@settings(max_examples=20, deadline=None)
def test_ladder_equals_one_exponential(seed, n):
    q = random_rates(seed, n)
    times = np.array([0.0, 0.01, 0.7, 3.3, 19.0])
    ladder = scoring.Ladder(q, 20.0)
    got = ladder.advance(np.tile(np.eye(n)[0], (5, 1)), times)
    want = np.vstack([chains.transition_matrix(q, t)[0] for t in times])
    assert np.allclose(got, want, atol=1e-9)


def test_generator_rows_sum_to_zero(table):
    sums = rates.generator(rates.rate_table(table)).groupBy("from_state").agg(F.sum("rate").alias("s"), F.sum(F.abs("rate")).alias("a"))
    assert all(abs(r.s) <= 1e-12 * max(r.a, 1) for r in sums.collect())


def test_transition_probability_rows_sum_to_one(table):
    p = scoring.transition_probabilities(rates.rate_table(table), 7 * DAY)
    assert all(r.s == pytest.approx(1) for r in p.groupBy("from_state").agg(F.sum("p").alias("s")).collect())


def test_no_smoothing_is_the_plain_generator(table):
    plain = {(r.from_state, r.to_state): r.rate for r in rates.rate_table(table).collect()}
    smooth = {(r.from_state, r.to_state): r.rate for r in rates.smoothed_rates(table, alpha=0.0).collect()}
    assert {k: v for k, v in smooth.items() if v > 0} == pytest.approx(plain)


def test_boundary_values(failing):
    totals = scoring.timeout_totals(failing)
    for t in (scoring.timeout_table(totals), scoring.semi_markov_table(scoring.fitted_weights(failing, timeout_seconds=DAY))):
        p = {r.state: r.p for r in t.collect()}
        assert p[28] == 1.0 and p[-1] == 0.0 and all(0 <= v <= 1 for v in p.values())


def test_exposure_split_keeps_the_interval(failing):
    split = transitions.age_bin_exposure(failing, (DAY, 3 * DAY, 9 * DAY))
    parts = split.groupBy("id", "seq").agg(F.sum("exposure_us").alias("us"), F.sum("jumps").alias("j"))
    joined = parts.join(failing, ["id", "seq"])
    assert joined.where("us <> dt_us OR j <> 1").isEmpty() and joined.count() == failing.count()


def test_equal_bins_give_one_exponential(spark, failing, small):
    fit = rates.rate_table(failing.where("state NOT IN (28, -1)")).select("from_state", "to_state", "rate")
    same = settle(fit.withColumn("segment", F.explode(F.array(F.lit("0"), F.lit("1"), F.lit("2")))))
    journeys = assemble.current_state(adapters.events_log(spark, small))
    got = scoring.piecewise_score(journeys, same, (2 * DAY, 5 * DAY), F.lit(0.0), horizon_seconds=4 * DAY)
    one = {r.state: r.p for r in scoring.horizon_table(fit.withColumn("segment", F.lit("all")), horizon_seconds=4 * DAY).collect()}
    assert all(r.p == pytest.approx(one[r.current_state], abs=1e-9) for r in got.collect())


def test_unit_speed_is_the_global_model(spark, table, small):
    fit = settle(rates.rate_table(table))
    journeys = assemble.current_state(adapters.events_log(spark, small)).select("id", "current_state")
    got = scoring.speed_score(journeys.withColumn("log_alpha", F.lit(0.0)), fit, horizon_seconds=DAY)
    one = {r.state: r.p for r in scoring.horizon_table(fit, horizon_seconds=DAY).collect()}
    assert all(r.p == pytest.approx(one[r.current_state], abs=1e-9) for r in got.collect())


def test_unknown_states_take_their_own_fallback(spark, table, failing):
    odd = spark.createDataFrame([("x", 999)], "id string, current_state long")
    first = scoring.fitted_totals(table)
    prior = rates.success_prior(first).first().prior
    assert scoring.horizon_score(odd, first).first().p == pytest.approx(prior)
    absorbing = scoring.timeout_totals(failing)
    assert scoring.timeout_score(odd, absorbing).first().p == pytest.approx(rates.terminal_share(absorbing).first().fallback)
    assert scoring.hitting_time(odd, first).first().seconds == float("inf")
    assert scoring.speed_score(odd.withColumn("log_alpha", F.lit(0.0)), settle(rates.rate_table(table))).first().p == 0.0


def test_realistic_snapshots_do_not_leak(spark, small):
    log = adapters.orders_log(spark, small)
    shots = settle(snapshots.realistic_snapshots(log, []))
    spans = assemble.journey_summary(log).select("id", "start_us", F.coalesce("completion_us", "end_us").alias("stop_us"))
    joined = shots.join(spans, "id")
    assert shots.where("current_state = 28 OR array_contains(array(last1_event, last2_event), 'order_shipped')").isEmpty()
    assert joined.where("label = 1 AND cutoff_us > start_us + 0.7 * (stop_us - start_us)").isEmpty()
    assert joined.where("cutoff_us > stop_us OR snapshot_us > cutoff_us").isEmpty()


def test_last_state_of_finished_journeys_leaks(spark, small):
    """Known leak kept as a case: scoring finished journeys by their last state looks perfect."""
    log = adapters.orders_log(spark, small)
    totals = scoring.timeout_totals(transitions.timeout_transitions(log))
    labels = assemble.binary_labels(assemble.labeled_journeys(log)).select("id", F.col("label").cast("int").alias("label"))
    rows = scoring.timeout_score(assemble.current_state(log).join(labels, "id"), totals).withColumn("model", F.lit("leaky"))
    assert evaluate.rank_metrics(rows, "model").first().roc_auc > 0.999


def test_isotonic_is_monotone_and_not_worse(spark, small):
    rows = settle(scored(spark, small).select("id", "label", F.col("blend").alias("p")))
    out = learn.isotonic(rows, rows).orderBy("p").toPandas()
    assert (np.diff(out.calibrated) >= -1e-12).all()
    assert ((out.calibrated - out.label) ** 2).mean() <= ((out.p - out.label) ** 2).mean() + 1e-12


def test_learners_beat_the_base_rate(spark, small):
    from wayfare.plans.catalog_evaluation import learning_frame

    rows, columns = learning_frame(spark, small)
    train = learn.with_weights(rows)
    model = learn.random_forest(columns, trees=20).fit(train)
    got = learn.probability(model, rows).withColumn("model", F.lit("rf"))
    assert evaluate.rank_metrics(got, "model").first().roc_auc > 0.7
    weights = {r.label: r.weight for r in learn.class_weights(rows).collect()}
    seen = {r.label: r.weight for r in train.select("label", "weight").distinct().collect()}
    assert seen == pytest.approx(weights)


def test_kmeans_and_spectral_find_separate_groups(spark):
    r = np.random.default_rng(1)
    points = np.vstack([r.normal(c, 0.2, size=(30, 2)) for c in (0, 6)])
    data = pd.DataFrame({"id": [f"r{i}" for i in range(60)], "a": points[:, 0], "b": points[:, 1]})
    df = spark.createDataFrame(data)
    fitted = segments.fit_kmeans(df, ["a", "b"], 2)
    for got in (
        fitted.assign(df),
        segments.spectral_segments(segments.feature_array(df, ["a", "b"]), 2, neighbours=5),
    ):
        pdf = got.select("id", "segment").toPandas()
        half = pdf.id.str[1:].astype(int) < 30
        assert pdf[half].segment.nunique() == 1 and pdf[~half].segment.nunique() == 1
        assert len(pdf) == 60


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(i, i + 1) for i in range(100, 120)]
    df = spark.createDataFrame(edges, "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in [*range(0, 41), *range(100, 121), 500]], "node long")
    got = {r.node: r.component for r in neighbours.components(df, nodes).collect()}
    assert got == {i: 0 if i <= 40 else 100 if i <= 120 else 500 for i in got}


def test_cluster_column_choice(spark):
    df = spark.createDataFrame(
        [("a", 1, 0.5, 4, 28, -1.0, 0)],
        "id string, num_transitions long, action_prop_4 double, first_state long, current_state long, time_to_action_28 double, seen_action_28 int",
    )
    assert segments.cluster_columns(df) == ["action_prop_4", "first_state", "current_state"]
    assert "seen_action_28" not in segments.cluster_columns(df, spectral=True)
    assert len(segments.cluster_columns(df, "all_numeric")) == 6
    with pytest.raises(ValueError):
        segments.cluster_columns(df, "other")


def test_scaling_fills_with_the_median(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (float("inf"),), (9.0,)], "x double")
    fitted = encode.fit_scaling(df, ["x"])
    median, mean, std = fitted.stats["x"]
    values = np.array([1, 2, 2, 2, 9.0])
    assert (median, mean, std) == pytest.approx((2.0, values.mean(), values.std()))
    got = sorted(r.x for r in fitted.apply(df).collect())
    assert got == pytest.approx(sorted((values - values.mean()) / values.std()))


def test_nearest_centre(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0), ("b", 1.0, 1.0), ("c", 0.5, 0.5), ("d", 0.9, 1.2)], "id string, x double, y double")
    centres = segments.group_centres(df.where("id IN ('a', 'b')"), ["x", "y"], "id")
    assert centres == [("a", [0.0, 0.0]), ("b", [1.0, 1.0])]
    got = {r["id"]: r["segment"] for r in segments.nearest_centre(df, ["x", "y"], centres).collect()}
    # A tie goes to the first segment.
    assert got == {"a": "a", "b": "b", "c": "a", "d": "b"}
    assert segments.nearest_centre(df.where("false"), ["x", "y"], centres).count() == 0
