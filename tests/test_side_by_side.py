"""Parts of the suite that wait for nothing of each other run together, and products of the graph sort no edges."""

from __future__ import annotations

import threading

from pyspark.sql import functions as F

from wayfare.operators import spectral
from wayfare.plans import suite
from wayfare.sources.log import open_log


def test_parts_of_the_suite_run_together(spark, monkeypatch):
    rows = [(f"{j}", 3_600 * i, "view" if i % 2 else "click", 4 if i % 2 else 2) for j in range(3) for i in range(4 + j)]
    events = spark.createDataFrame(rows, "id string, at long, event_name string, ed_id long").withColumn("event_timestamp", F.timestamp_seconds("at"))
    together = threading.Barrier(2)

    def part(name):
        def run(log, base, *given, **options):
            together.wait(timeout=60)
            return {name: base.select("id", F.lit(0.5).alias("p"))}

        return run

    monkeypatch.setattr(suite, "_segmented", part("spectral"))
    monkeypatch.setattr(suite, "_truncated", part("truncated_kmeans"))
    out = suite.score_suite(open_log(events), models=("spectral", "truncated_kmeans"), test_prevalence=None)
    assert {r["model"] for r in out.collect()} == {"spectral", "truncated_kmeans"}


def test_products_sort_nothing(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, weight double")
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 5.0])], "node string, t array<double>")
    out = spectral._product(edges, rows, 2, True)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert {r["node"]: list(r["t"]) for r in out.collect()} == {"a": [1.0, 2.0, 3.0, 5.0], "b": [3.0, 5.0, 1.0, 2.0]}
