"""Prepared tables and the scoring suite end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfare.operators import assemble
from wayfare.plans.build import build_tables, model_bundle
from wayfare.plans.suite import score_suite
from wayfare.sources import adapters

DAY = 86_400


def test_build_tables(spark, small, tmp_path):
    log = adapters.orders_log(spark, small)
    paths = build_tables(log, str(tmp_path), max_samples=3)
    tables = {name: spark.read.parquet(path) for name, path in paths.items()}
    events = assemble.journey_events(tables["flattened"])
    assert events.count() == log.events.count()
    status = {r.journey_status: r.n for r in assemble.status_counts(tables["labeled"]).collect()}
    resolved = status.get("successful", 0) + status.get("incomplete", 0)
    assert tables["training"].count() == resolved
    assert tables["timed"].select("id").distinct().count() == resolved
    assert tables["open"].count() <= status["other"]
    assert tables["realistic"].where("sample_num > 3").isEmpty()


def test_suite_scores_every_open_journey(spark, small):
    log = adapters.events_log(spark, small)
    models = ["global", "timeout", "semi_markov", "clustered", "blend", "temporal", "order_2"]
    out = score_suite(
        log,
        models=models,
        horizon_seconds=DAY,
        timeout_seconds=DAY,
        label_horizon_seconds=DAY // 2,
        edges=(DAY, 7 * DAY),
        success_event="purchase",
        test_prevalence=None,
    ).toPandas()
    opened = assemble.open_journeys(log, horizon_seconds=DAY // 2).count()
    assert out.groupby("model").id.nunique().to_dict() == dict.fromkeys(models, opened)
    assert out.p.between(0, 1).all()
    wide = out.pivot(index="id", columns="model", values="p")
    mean = wide[["global", "timeout", "semi_markov", "clustered"]].mean(axis=1)
    assert (wide["blend"] - mean).abs().max() < 1e-9


def test_model_bundle(spark, small):
    parts = model_bundle(adapters.events_log(spark, small), clusters=2)
    whole = parts["global_totals"].agg(F.sum("n")).first()[0]
    assert parts["segment_totals"].agg(F.sum("n")).first()[0] == whole
    assert parts["segments"].count() == parts["features"].count()
