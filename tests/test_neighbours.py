"""Neighbour search over cells and blocks against brute force, spread of large values, events without a name."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.functions.ranks import cumulative_counts, even_slices, profile_values
from wayfare.operators import neighbours, snapshots
from wayfare.session import shared_folder
from wayfare.sources.log import open_log


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 1.0, (40, 3)) for c in (0, 8, 40)])
    x[5] = x[6]
    return x


def brute(x, k, allowed):
    out = {}
    for i in range(len(x)):
        gaps = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        near = sorted((float(g), j) for j, g in enumerate(gaps) if allowed(i, j))[:k]
        out[i] = [j for _, j in near]
    return out


@pytest.mark.parametrize("cell_rows, block", [(1024, 2048), (9, 2048), (9, 4)])
def test_small_cells_and_blocks_change_nothing(spark, points, monkeypatch, cell_rows, block):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", block)
    df = spark.createDataFrame([(i, i % 3, p.tolist()) for i, p in enumerate(points)], "id long, part int, features array<double>")
    for given, allowed in (({"exclude_self": True}, lambda i, j: i != j), ({"tag": "part"}, lambda i, j: i % 3 != j % 3), ({}, lambda i, j: True)):
        got = {}
        for r in sorted(neighbours.nearest_neighbours(df, df, 4, cell_rows=cell_rows, **given).collect(), key=lambda r: r["rank"]):
            got.setdefault(r["id"], []).append(r["neighbour"])
        assert got == brute(points, 4, allowed)


@pytest.mark.parametrize("kind", ["double", "float"])
def test_many_slabs_change_nothing_and_leave_nothing(spark, points, kind):
    """Rounds over small slabs, names as text, equal distances, and rows of ``df`` that are not in ``base``; disk does not grow with the rounds."""
    x = points.astype(np.float32).astype(float)
    df = spark.createDataFrame([(f"n{i:03d}", p.tolist()) for i, p in enumerate(x)], f"id string, features array<{kind}>")
    one, many = ([sorted(map(tuple, neighbours.nearest_neighbours(df, base, 5, exclude_self=True, cell_rows=9, slab_bytes=b).collect())) for base in (df, df.where("id < 'n060'"))] for b in (10**6, 1_000))
    assert one == many
    got = {}
    for i, j, _, _ in sorted(many[0], key=lambda r: (r[0], r[3])):
        got.setdefault(int(i[1:]), []).append(int(j[1:]))
    assert got == brute(x, 5, lambda i, j: i != j)
    before = shared_bytes(spark)
    neighbours.nearest_neighbours(df, df, 5, exclude_self=True, slab_bytes=10**6).collect()
    between = shared_bytes(spark)
    neighbours.nearest_neighbours(df, df, 5, exclude_self=True, slab_bytes=700).collect()
    assert shared_bytes(spark) - between < 1.5 * (between - before)


def shared_bytes(spark):
    return sum(p.stat().st_size for p in Path(shared_folder(spark).removeprefix("file:")).rglob("*") if p.is_file())


def test_graph_is_joined_by_its_shortest_edges(spark, points):
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, features array<double>")
    edges = neighbours.connected_graph(df, 2)
    labels = neighbours.components(edges, df.select(F.col("id").alias("node")))
    assert labels.select("component").distinct().count() == 1


def test_spread_of_large_close_values(spark):
    values = 1.7e9 + np.arange(1000) / 1000
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = profile_values(df, "v", {"median": 0.5}).first()
    assert got["std"] == pytest.approx(values.std(ddof=1), rel=1e-4)


def test_close_values_spread_over_slices(spark):
    values = [i * 1e-9 for i in range(4_000)]
    df = spark.createDataFrame([(v, "ab"[i % 2]) for i, v in enumerate(values)], "v double, g string")
    sizes = [r["count"] for r in even_slices(df, ["v"]).groupBy("slice").count().collect()]
    assert len(sizes) == 2 and max(sizes) < 2_600
    got = {(r["g"], r["v"]): (r["upto"], r["total"]) for r in cumulative_counts(df.union(df), "v", by=("g",)).collect()}
    assert got == {("ab"[i % 2], v): (2 * (i // 2 + 1), 4_000) for i, v in enumerate(values)}


def test_events_without_a_name_stay(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [("a", at(0), "browse", 4), ("a", at(1), None, 11), ("a", at(2), "checkout", 6), ("a", at(3), "order_shipped", 28)]
    log = open_log(spark.createDataFrame(rows, "id string, event_timestamp timestamp, event_name string, ed_id long"))
    got = snapshots.open_snapshots(log, ["browse"]).first()
    assert got["num_events"] == 3
