"""Evaluation of scores, splits and sweeps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions.columns import calibration_bin, clip, uniform
from wayfare.functions.ordered import SLICE, along_slices, nth, running_sum, total_sum
from wayfare.functions.ranks import cumulative_counts, profile_values, sliced_running
from wayfare.session import settle

EDGE = 1e-6
SPLIT_SLICES = 65_536
# Metrics where a larger value is better; for all others a smaller one is.
LARGER_IS_BETTER = ("roc_auc", "average_precision", "accuracy", "balanced_accuracy", "precision", "recall", "f1")


def _p(p: str) -> Column:
    return clip(F.col(p), EDGE, 1 - EDGE)


def point_metrics(df: DataFrame, *by: str, p: str = "p", label: str = "label") -> DataFrame:
    """Brier score and log loss in one aggregation."""
    y, q = F.col(label), _p(p)
    return df.groupBy(*by).agg(
        F.avg((q - y) * (q - y)).alias("brier_score"),
        (-F.avg(F.when(y == 1, F.log(q)).otherwise(F.log(1 - q)))).alias("log_loss"),
    )


def rank_metrics(df: DataFrame, *by: str, p: str = "p", label: str = "label") -> DataFrame:
    """ROC AUC (ties count half) and average precision from counts per distinct score."""
    rows = df.withColumn("_p", _p(p))
    y = F.col(label)
    counts = rows.groupBy(*by, "_p").agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y != 1).alias("neg")
    )
    steps = {
        "pos_upto": running_sum(F.col("pos")),
        "neg_upto": running_sum(F.col("neg")),
        "pos_all": total_sum(F.col("pos")),
        "neg_all": total_sum(F.col("neg")),
    }
    table = sliced_running(counts, "_p", steps, by=by)
    above_pos = F.col("pos_all") - F.col("pos_upto") + F.col("pos")
    above_neg = F.col("neg_all") - F.col("neg_upto") + F.col("neg")
    wins = F.col("pos").cast("double") * (F.col("neg_upto") - F.col("neg") / 2)
    return table.groupBy(*by).agg(
        F.try_divide(F.sum(wins), F.max("pos_all").cast("double") * F.max("neg_all")).alias("roc_auc"),
        F.sum(
            F.try_divide(F.col("pos"), F.col("pos_all")) * F.try_divide(above_pos, above_pos + above_neg)
        ).alias("average_precision"),
    )


def threshold_metrics(df: DataFrame, *by: str, predicted: str = "predicted", label: str = "label") -> DataFrame:
    """Accuracy, balanced accuracy, precision, recall and F1; empty denominators give 0."""
    y, z = F.col(label) == 1, F.col(predicted) == 1
    tp, fp = F.count_if(y & z), F.count_if(~y & z)
    fn, tn = F.count_if(y & ~z), F.count_if(~y & ~z)

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return df.groupBy(*by).agg(
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ((ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2).alias("balanced_accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def all_metrics(df: DataFrame, by: str = "model", *, p: str = "p", label: str = "label") -> DataFrame:
    """One row per model: AUC, average precision, log loss, Brier score."""
    return rank_metrics(df, by, p=p, label=label).join(point_metrics(df, by, p=p, label=label), by)


def calibration_table(df: DataFrame, *by: str, p: str = "p", label: str = "label", bins: int = 10) -> DataFrame:
    rows = df.withColumn("_p", clip(F.col(p)))
    return rows.groupBy(*by, calibration_bin(F.col("_p"), bins).alias("bin")).agg(
        F.avg("_p").alias("mean_predicted"), F.avg(label).alias("observed_rate"), F.count(F.lit(1)).alias("count")
    )


def prediction_summary(long: DataFrame, template: DataFrame, *, by: str = "model", p: str = "p") -> DataFrame:
    """Per model against a template (id, ordinal): rows, order match, missing ids, spread of the scores.

    ``long`` has id, model, ordinal (the place of the row in what was written, see ``output.written_order``), p; order matches when every
    row stands where the template has its id.
    """
    wanted = template.select("id", F.col("ordinal").alias("_want"))
    counts = long.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"))
    placed = long.join(wanted, "id", "left").groupBy(by).agg(
        F.count_if(F.col("_want").isNotNull()).alias("_found"),
        F.bool_and(F.col("_want").eqNullSafe(F.col("ordinal"))).alias("_same"),
    )
    total = template.select(F.count(F.lit(1))).scalar()
    stats = profile_values(long, p, {"p50": 0.5, "p90": 0.9, "p99": 0.99}, by=(by,))
    return (
        counts.join(placed, by)
        .join(stats.drop("n"), by)
        .withColumn("missing", total - F.col("_found"))
        .withColumn("order_matches", F.col("_same") & (F.col("n_rows") == total))
        .select(by, "n_rows", "order_matches", "missing", "mean", "std", "min", "p50", "p90", "p99", "max")
    )


def score_diagnostics(df: DataFrame, *by: str, p: str = "p", prevalence: float) -> DataFrame:
    """Mean score, share above one half and the Brier score of the all-zero prediction."""
    return df.groupBy(*by).agg(
        F.avg(p).alias("mean_p"),
        F.avg((F.col(p) > 0.5).cast("double")).alias("share_above_half"),
        F.lit(float(prevalence)).alias("all_zero_brier"),
    )


def ecdf(df: DataFrame, *by: str, p: str = "p") -> DataFrame:
    """Share of rows at or below each distinct score."""
    table = cumulative_counts(df, p, by=by)
    return table.select(*by, p, "n", (F.col("upto") / F.col("total")).alias("share"))


def risk_curve(df: DataFrame, *by: str, p: str = "p", points: int = 2_000, top: float = 0.25) -> DataFrame:
    """Scores sorted high to low, every stride-th rank of the top share.

    Ranks come from the counts of distinct scores; rows are never sorted.
    """
    table = cumulative_counts(df, p, by=by)
    stride = F.greatest(F.lit(1), F.floor(F.col("total") / points)).cast("long")
    first = F.col("total") - F.col("upto")
    last = first + F.col("n") - 1
    start = (F.ceil(first / F.col("stride")) * F.col("stride")).cast("long")
    ranked = table.withColumn("stride", stride).withColumns({"_from": start, "_to": last})
    picked = ranked.where(F.col("_from") <= F.col("_to")).withColumn(
        "rank", F.explode(F.sequence("_from", "_to", "stride"))
    )
    out = picked.select(*by, "rank", (F.col("rank") / F.col("total")).alias("fraction"), p)
    return out.where(F.col("fraction") <= top)


def spearman(wide: DataFrame, models: Sequence[str]) -> DataFrame:
    """Rank correlation of every model pair: average ranks per distinct score, then Pearson in one pass."""
    long = wide.select(
        "id", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("p")) for m in models])).alias("e")
    ).select("id", "e.model", "e.p")
    table = cumulative_counts(long, "p", by=("model",))
    ranks = settle(table.select("model", "p", (F.col("upto") - (F.col("n") - 1) / 2).alias("rank")))
    out = wide.select("id", *models)
    for i, m in enumerate(models):
        # State scores have few values and the rank table is broadcast; many values mean no heavy key.
        part = ranks.where(F.col("model") == m).select(F.col("p").alias(m), F.col("rank").alias(f"_r{i}"))
        out = out.join(part, m, "left")
    pairs = list(combinations(range(len(models)), 2))
    wide_corr = out.agg(*[F.corr(f"_r{a}", f"_r{b}").alias(f"_c{a}_{b}") for a, b in pairs])
    cells = [
        F.struct(F.lit(models[a]).alias("model_a"), F.lit(models[b]).alias("model_b"), F.col(f"_c{a}_{b}").alias("rho"))
        for a, b in pairs
    ]
    return wide_corr.select(F.explode(F.array(*cells)).alias("e")).select("e.*")


def score_by_current_state(wide: DataFrame, models: Sequence[str], *, top: int = 10, state: str = "current_state") -> DataFrame:
    """Mean and median score per model for the most frequent current states."""
    best = wide.where(F.col(state).isNotNull()).groupBy(state).agg(F.count(F.lit(1)).alias("_n"))
    best = best.orderBy(F.desc("_n"), state).limit(top).select(state)
    long = wide.join(best, state, "left_semi").select(
        state, F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("p")) for m in models])).alias("e")
    ).select("e.model", state, "e.p")
    stats = profile_values(long, "p", {"median": 0.5}, by=("model", state))
    return stats.select(
        "model", state, F.col("mean").alias("mean_probability"), F.col("median").alias("median_probability"), "n"
    )


def _label_rank(labels: DataFrame, label: str, seed: int) -> DataFrame:
    """Random but repeatable rank of each journey inside its label, sliced by the draw itself."""
    rows = labels.withColumn("_u", uniform(seed, "id"))
    rows = rows.withColumn(SLICE, F.floor(F.col("_u") * SPLIT_SLICES).cast("int"))
    return along_slices(
        rows, {"_rank": nth(), "_size": total_sum(F.lit(1))}, key=(label,), order=("_u", "id")
    ).drop(SLICE)


def stratified_split(labels: DataFrame, test_share: float = 0.25, *, label: str = "label", seed: int = 42) -> DataFrame:
    """is_test per journey with the same share of every label."""
    rows = _label_rank(labels, label, seed)
    cut = F.round(F.col("_size") * F.lit(test_share))
    return rows.withColumn("is_test", F.col("_rank") <= cut).drop("_u", "_rank", "_size")


def stratified_folds(labels: DataFrame, folds: int = 5, *, label: str = "label", seed: int = 42) -> DataFrame:
    """fold 0..folds-1 per journey with equal label mix."""
    rows = _label_rank(labels, label, seed)
    return rows.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(folds)).cast("int")).drop("_u", "_rank", "_size")


def metric_ranking(table: DataFrame, metrics: Sequence[str], by: str = "model") -> DataFrame:
    """Models ranked per metric, best first (a table with one row per model)."""
    cells = [
        F.struct(
            F.lit(m).alias("metric"),
            F.col(m).cast("double").alias("value"),
            (-F.col(m) if m in LARGER_IS_BETTER else F.col(m)).cast("double").alias("_key"),
        )
        for m in metrics
    ]
    long = table.select(by, F.explode(F.array(*cells)).alias("e")).select(by, "e.*")
    rank = F.row_number().over(Window.partitionBy("metric").orderBy("_key", by))
    return long.withColumn("rank", rank).drop("_key")


def best_trial(trials: DataFrame, *by: str, score: str, params: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """The parameter row with the smallest score."""
    names = list(params)
    return trials.groupBy(*by).agg(
        F.min(score).alias(score), F.min_by(F.struct(*names), F.struct(score, *names)).alias("_b")
    ).select(*by, score, "_b.*")
