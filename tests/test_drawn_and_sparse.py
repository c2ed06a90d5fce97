"""Exact draws without an ordered table, and goal scores without a matrix of states."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayfare.functions import chains
from wayfare.functions.columns import uniform
from wayfare.operators import clean


@pytest.mark.parametrize("n", [0, 1, 37, 400, 5000])
def test_drawn_journeys_are_the_first_by_hash(spark, monkeypatch, n):
    monkeypatch.setattr(clean, "RANGE_BITS", 3)
    monkeypatch.setattr(clean, "ORDERED_IDS", 2)
    events = spark.range(1500).select((F.col("id") % 500).cast("string").alias("id"), F.col("id").alias("v"))
    got = clean.sample_journeys(events, n, seed=5)
    want = [r["id"] for r in events.select("id").distinct().orderBy(uniform(5, "id"), "id").limit(n).collect()]
    assert {r["id"] for r in got.select("id").distinct().collect()} == set(want)
    assert got.count() == 3 * len(want)


@pytest.mark.parametrize("horizon", [0.0, 0.3, 40.0, 3000.0])
def test_goal_vector_equals_the_matrix(horizon):
    draw = np.random.RandomState(3)
    names = np.array([f"s{i:03}" for i in range(80)])
    rows = [(a, b, float(draw.gamma(1.0) * 10.0 ** draw.randint(-3, 1))) for a in names[:-1] for b in draw.choice(names, 4, replace=False) if a != b]
    table = pd.DataFrame(rows, columns=["from_state", "to_state", "rate"])
    dense = chains.horizon_hits(table, names[-1], horizon)
    sparse = chains.goal_hits(table, names[-1], horizon, dense_states=0)
    assert dense["state"].tolist() == sparse["state"].tolist()
    assert np.abs(dense["p"].to_numpy() - sparse["p"].to_numpy()).max() < 1e-9
    assert chains.goal_hits(table, "none", horizon, dense_states=0)["p"].max() == 0


def test_many_histories_need_edges_only():
    n = 50_000
    names = np.array([f"h{i:05}" for i in range(n)])
    source = np.repeat(np.arange(n - 1), 4)
    target = (source * 7 + np.tile([1, 11, 101, 1009], n - 1)) % n
    table = pd.DataFrame({"from_state": names[source], "to_state": names[target], "rate": 0.25})
    found = chains.goal_hits(table[source != target], names[-1], 20.0)
    assert len(found) == n and found["p"].max() == 1.0 and 0 < found["p"].mean() < 0.5
