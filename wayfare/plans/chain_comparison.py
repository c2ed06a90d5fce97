"""Plain, smoothed and calibrated chains on one hold-out.

Calibration is cross-fitted: a training journey is scored by the totals of the folds it is not in, so the curve never sees a score
that knew its journey.  All folds' totals come from one aggregation of the transitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.constants import HORIZON_SECONDS, SUCCESS_STATE
from wayfare.functions.columns import clip
from wayfare.operators import evaluate, learn, scoring
from wayfare.operators import rates as R
from wayfare.plans.sweeps import held_out_totals, journey_states
from wayfare.session import settle

MODELS = ("plain", "smoothed")


def chain_scores(
    table: DataFrame,
    labels: DataFrame,
    *,
    test_share: float = 0.3,
    folds: int = 5,
    alpha: float = 0.5,
    horizon_seconds: float = HORIZON_SECONDS,
    success_state: int = SUCCESS_STATE,
    seed: int = 42,
) -> DataFrame:
    """id, label, is_test and a score per model: test journeys by all training totals, training journeys by those of the other folds.

    ``labels`` has id and label.  States that a chain does not know take its share of moves into success.
    """
    split = settle(evaluate.stratified_split(labels.select("id", "label"), test_share, seed=seed))
    train = evaluate.stratified_folds(split.where("NOT is_test").select("id", "label"), folds, seed=seed)
    placed = settle(split.join(train.select("id", "fold"), "id", "left").withColumn("segment", F.coalesce(F.col("fold").cast("string"), F.lit(R.GLOBAL))))
    moves = table.join(placed.where("NOT is_test").select("id", "fold"), "id")
    cells = settle(R.pair_totals(moves, F.col("fold")).withColumn("fold", F.col("segment").cast("int")).drop("segment"))
    whole = cells.groupBy("from_state", "to_state").agg(F.sum("n").alias("n"), F.sum("dwell_us").alias("dwell_us")).withColumn("segment", F.lit(R.GLOBAL))
    others = held_out_totals(cells, folds, []).withColumn("segment", F.col("held").cast("string")).drop("held")
    totals = settle(whole.unionByName(others))
    smooth = settle(R.smoothed_totals(totals, alpha=alpha))
    out = journey_states(table).select("id", "current_state").join(placed.select("id", "label", "is_test", "segment"), "id")
    for model, rates, counts in (
        ("plain", R.with_rates(totals), totals),
        ("smoothed", smooth, smooth.withColumn("n", F.col("n") + F.lit(alpha))),
    ):
        hits = settle(scoring.horizon_table(rates, success_state=success_state, horizon_seconds=horizon_seconds))
        prior = settle(R.success_prior(counts, success_state))
        out = scoring.look_up(out, hits, F.lit(None).cast("double"), segment="segment").join(prior, "segment", "left")
        out = out.withColumn(model, clip(F.coalesce("p", "prior", F.lit(0.0)))).drop("p", "prior")
    return settle(out.select("id", "label", "is_test", *MODELS))


def compare_chains(scores: DataFrame, *, calibrated: bool = True) -> DataFrame:
    """One row of metrics per model on the test journeys of ``chain_scores``; the calibrated ones follow an isotonic fit on the others."""
    test = scores.where("is_test")
    parts = [test.select(F.lit(m).alias("model"), "id", "label", F.col(m).alias("p")) for m in MODELS]
    if calibrated:
        for m in MODELS:
            named = scores.select("id", "label", "is_test", F.col(m).alias("p"))
            found = learn.isotonic(named.where("NOT is_test"), named.where("is_test"))
            parts.append(found.select(F.lit(f"calibrated_{m}").alias("model"), "id", "label", F.col("calibrated").alias("p")))
    long = parts[0]
    for part in parts[1:]:
        long = long.unionByName(part)
    return evaluate.all_metrics(settle(long), "model")
