"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from wayfare.plans.catalog import all_queries  # noqa: E402
from wayfare.session import local_session, release_settled  # noqa: E402

HEADLINE = [
    "dedup_events",
    "journey_length_stats",
    "interevent_gap_stats",
    "flatten_journeys",
    "label_last_action",
    "status_summary",
    "snapshot_frac",
    "prefix_features",
    "snapshot_time",
    "snapshot_features",
    "snapshot_features_orders",
    "trailing_windows",
    "open_features",
    "transitions",
    "timeout_transitions",
    "suffix_transitions",
    "age_bin_exposure",
    "order_k_history",
    "generator",
    "timeout_absorption",
    "semi_markov",
    "piecewise_generator",
    "order3_generator",
    "timeout_score",
    "horizon_score",
    "clustered_score",
    "piecewise_score",
    "order_k_score",
    "journey_features",
    "nearest_neighbours",
    "roc_auc",
    "calibration_table",
    "spearman",
    "stratified_split",
    "edge_sweep",
    "submission",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    found = all_queries()
    # The first job pays for the JVM and the Python workers; it is not a query.
    spark.range(1000).selectExpr("sum(id)").collect()
    spent = {}
    for name in names:
        started = time.perf_counter()
        found[name].plan(spark, folder).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - started, 3)
        release_settled(spark)
        print(f"{name} {spent[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(spent.values()), 3),
                "unit": "sec",
                "queries": spent,
                "sf": float(scale.group(1)) if scale else folder,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
