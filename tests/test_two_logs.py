"""Fits on one log, scores of another, and the store of fits."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from wayfare.operators import assemble, scoring, transitions
from wayfare.plans.two_logs import MODELS, FitStore, source_digest, two_log_scores
from wayfare.sources import adapters
from wayfare.sources.log import open_log

SETTINGS = {"horizon_seconds": 43_200, "timeout_seconds": 86_400, "label_horizon_seconds": 43_200}


@pytest.fixture
def template(spark):
    ids = [str(i) for i in range(60, 0, -1)] + ["nobody"]
    return spark.createDataFrame(list(enumerate(ids)), "ordinal long, id string")


def test_a_second_run_does_not_read_the_training_log(spark, small, tmp_path, template):
    store = FitStore(spark, str(tmp_path))
    events, orders = adapters.raw_events(spark, small), adapters.raw_orders(spark, small)
    read = []

    def opened(df):
        read.append(source_digest(df))
        return open_log(df)

    first = two_log_scores(events, orders, template, store, opened=opened, **SETTINGS)
    assert read == [source_digest(events), source_digest(orders)]
    again = two_log_scores(events, orders, template, store, opened=opened, **SETTINGS)
    assert read[2:] == [source_digest(orders)]
    assert rows(first) == rows(again)
    # Other parameters or another log are another fit, which leaves the first one as it is.
    two_log_scores(events, orders, template, store, opened=opened, **SETTINGS | {"timeout_seconds": 3_600})
    two_log_scores(orders, orders, template, store, opened=opened, **SETTINGS)
    assert len(read) == 7 and [m["version"] for m in store.manifests("chains")] == [1, 2, 3]
    two_log_scores(events, orders, template, store, opened=opened, **SETTINGS)
    assert len(read) == 8


def test_scores_are_those_of_the_models_in_template_order(spark, small, tmp_path, template):
    store = FitStore(spark, str(tmp_path))
    events, orders = adapters.raw_events(spark, small), adapters.raw_orders(spark, small)
    got = two_log_scores(events, orders, template, store, **SETTINGS).collect()
    assert [r["ordinal"] for r in got] == list(range(61)) and [r["id"] for r in got][:2] == ["60", "59"]
    totals = scoring.fitted_totals(transitions.transitions(open_log(events)))
    want = {r["id"]: r["p"] for r in scoring.horizon_score(assemble.current_state(open_log(orders)), totals, horizon_seconds=43_200).collect()}
    assert len(want) > 30
    for r in got:
        assert r["horizon"] == pytest.approx(want.get(r["id"], 0.0))
        assert r["blend"] == pytest.approx(sum(r[m] for m in MODELS) / 3)
    assert [got[-1][m] for m in MODELS] == [0.0, 0.0, 0.0]


def test_a_fit_without_a_manifest_is_not_found(spark, tmp_path):
    store = FitStore(spark, str(tmp_path))
    table = spark.range(3).select(F.col("id").alias("n"))

    class Broken(Exception):
        pass

    def broken():
        raise Broken

    with pytest.raises(Broken):
        store.keep("m", {"a": 1}, "s", {"one": table, "two": type("D", (), {"write": property(lambda self: broken())})()})
    assert store.find("m", {"a": 1}, "s") is None
    store.keep("m", {"a": 1}, "s", {"one": table})
    assert [m["version"] for m in store.manifests("m")] == [2]
    assert store.find("m", {"a": 1}, "s")["one"].count() == 3
    assert store.find("m", {"a": 2}, "s") is None and store.find("m", {"a": 1}, "t") is None


def test_a_log_without_files_needs_a_name(spark):
    with pytest.raises(ValueError):
        source_digest(spark.createDataFrame([(1,)], "a int"))


def test_chains_are_compared_on_scores_that_do_not_know_their_journeys(spark, small):
    from wayfare.plans.chain_comparison import chain_scores, compare_chains

    log = adapters.events_log(spark, small)
    table = transitions.transitions(log)
    labels = assemble.labeled_journeys(log, horizon_seconds=43_200).select("id", (F.col("journey_status") == "successful").cast("int").alias("label"))
    scores = chain_scores(table, labels, horizon_seconds=43_200, alpha=0.0)
    found = scores.collect()
    assert found and all(r["plain"] == pytest.approx(r["smoothed"], abs=1e-9) for r in found if r["plain"] > 0)
    # A training journey's score does not move with its own transitions.
    one = next(r["id"] for r in found if not r["is_test"])
    doubled = table.unionByName(table.where(F.col("id") == one))
    again = {r["id"]: r["plain"] for r in chain_scores(doubled, labels, horizon_seconds=43_200).collect()}
    assert again[one] == pytest.approx(next(r["plain"] for r in found if r["id"] == one), abs=1e-12)
    models = {r["model"] for r in compare_chains(chain_scores(table, labels, horizon_seconds=43_200)).collect()}
    assert models == {"plain", "smoothed", "calibrated_plain", "calibrated_smoothed"}


def test_order_check_tells_a_submission_out_of_order(spark, tmp_path):
    from wayfare.operators import evaluate, output

    template = spark.createDataFrame([(str(i), i) for i in range(50)], "id string, ordinal long")
    scores = template.select("id", (F.col("ordinal") / 50).alias("p"))
    right = output.align_submission(template, scores)
    wrong = right.orderBy(F.col("ordinal") % 7, "ordinal")
    long = None
    for name, rows_ in (("right", right), ("wrong", wrong)):
        rows_.select("id", "order_shipped").write.parquet(f"{tmp_path}/{name}")
        part = output.written_order(spark, f"{tmp_path}/{name}").select(F.lit(name).alias("model"), "id", "ordinal", F.col("order_shipped").alias("p"))
        long = part if long is None else long.unionByName(part)
    found = {r["model"]: r["order_matches"] for r in evaluate.prediction_summary(long, template).collect()}
    assert found == {"right": True, "wrong": False}
