"""Registered queries run with the operators' own sizes."""

from __future__ import annotations

import inspect

import pytest

from wayfare.operators import learn
from wayfare.plans import catalog_evaluation as evaluation
from wayfare.plans.catalog import all_queries
from wayfare.plans.suite import score_suite


def test_suite_and_k_sweep(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(evaluation.adapters, "events_log", lambda *a: None)
    monkeypatch.setattr(evaluation, "score_suite", lambda *a, **k: seen.update(k))
    monkeypatch.setattr(evaluation, "sweep_inputs", lambda *a: (None, seen.update(input_folds=a[2])))
    monkeypatch.setattr(evaluation, "k_sweep", lambda table, labels, ks, **k: seen.update(k, ks=ks))
    queries = all_queries()
    queries["suite"].plan(spark, "")
    queries["k_sweep"].plan(spark, "")
    assert seen.get("max_samples", 60) == inspect.signature(score_suite).parameters["max_samples"].default == 60
    assert (seen["input_folds"], seen["folds"], seen["ks"]) == (5, 5, list(range(2, 13)))


@pytest.mark.parametrize("name", ["rf_scores", "gbt_scores", "holdout_accuracy"])
def test_learners(spark, monkeypatch, name):
    seen = []
    monkeypatch.setattr(evaluation, "learner_scores", lambda spark, folder, make: seen.append(make) or [None] * 4)
    monkeypatch.setattr(learn, "holdout_accuracy", lambda rows: None)
    all_queries()[name].plan(spark, "")
    assert seen in ([learn.random_forest], [learn.boosting])
