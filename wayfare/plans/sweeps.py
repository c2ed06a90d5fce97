"""Cross-validated sweeps and rule comparisons built from one pass over the transitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.constants import HORIZON_SECONDS, MIN_BIN_TRANSITIONS, SUCCESS_STATE
from wayfare.functions.columns import clip
from wayfare.operators import evaluate, many_means, segments, snapshots, transitions
from wayfare.operators import rates as R
from wayfare.operators import scoring
from wayfare.operators.encode import fit_scaling
from wayfare.session import settle
from wayfare.sources.log import JourneyLog


def journey_states(table: DataFrame) -> DataFrame:
    """Current state and observed time of every journey of a transition table."""
    return table.groupBy("id").agg(
        F.max_by("next_state", "seq").alias("current_state"),
        (F.sum("dt_us") / F.lit(1e6)).alias("observed_age_seconds"),
    )


def held_out_totals(cells: DataFrame, folds: int, keys: Sequence[str]) -> DataFrame:
    """Totals of all folds but one, for every fold, from per-fold totals."""
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda x: x != F.col("fold"))
    return (
        cells.withColumn("held", F.explode(others))
        .groupBy(*keys, "held", "from_state", "to_state")
        .agg(F.sum("n").alias("n"), F.sum("dwell_us").alias("dwell_us"))
    )


def edge_sweep(
    table: DataFrame,
    labels: DataFrame,
    grid: Sequence[tuple[float, float]],
    *,
    folds: int = 5,
    horizon_seconds: float = HORIZON_SECONDS,
    min_rows: int = MIN_BIN_TRANSITIONS,
    success_state: int = SUCCESS_STATE,
) -> DataFrame:
    """Mean Brier score of the age-stratified model for every (edge1, edge1 + delta) in seconds.

    ``labels`` has id, label, fold.  The grid rides along as a short array, folds are combined from
    per-fold totals; the transitions are aggregated once for all trials.
    """
    points = F.array(
        *[
            F.struct(F.lit(i).alias("trial"), F.lit(float(a)).alias("edge1"), F.lit(float(a + d)).alias("edge2"))
            for i, (a, d) in enumerate(grid)
        ]
    )
    rows = R.journey_ages(table).join(labels.select("id", "fold"), "id").withColumn("g", F.explode(points))
    age = F.col("end_us") / F.lit(1e6)
    bins = (age >= F.col("g.edge1")).cast("int") + (age >= F.col("g.edge2")).cast("int")
    cells = settle(
        rows.groupBy(
            F.col("g.trial").alias("trial"), "fold", bins.alias("bin"),
            F.col("state").alias("from_state"), F.col("next_state").alias("to_state"),
        ).agg(F.count(F.lit(1)).alias("n"), F.sum("dt_us").alias("dwell_us"))
    )
    per_bin = held_out_totals(cells, folds, ["trial", "bin"])
    group = ["trial", "held"]
    sizes = per_bin.groupBy(*group, "bin").agg(F.sum("n").alias("_size")).where(F.col("_size") >= min_rows)
    kept = per_bin.join(sizes.drop("_size"), [*group, "bin"], "left_semi")
    pooled = per_bin.groupBy(*group, "from_state", "to_state").agg(
        F.sum("n").alias("n"), F.sum("dwell_us").alias("dwell_us")
    ).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(2))))
    thin = pooled.join(sizes, [*group, "bin"], "left_anti")
    totals = settle(
        kept.unionByName(thin)
        .withColumn("segment", F.concat_ws("|", "trial", "held", "bin"))
        .select("segment", "from_state", "to_state", "n", "dwell_us")
    )
    found = journey_states(table).join(labels, "id").withColumn("g", F.explode(points))
    seen = F.col("observed_age_seconds")
    found = found.withColumns(
        {
            "trial": F.col("g.trial"),
            "edge1": F.col("g.edge1"),
            "edge2": F.col("g.edge2"),
            "segment": F.concat_ws(
                "|", "g.trial", "fold", (seen >= F.col("g.edge1")).cast("int") + (seen >= F.col("g.edge2")).cast("int")
            ),
        }
    ).drop("g")
    prior = R.success_prior(totals, success_state)
    table_p = scoring.horizon_table(R.with_rates(totals), success_state=success_state, horizon_seconds=horizon_seconds)
    scored = scoring.look_up(found, table_p, F.lit(None).cast("double"), segment="segment").join(prior, "segment", "left")
    scored = scored.withColumn("p", clip(F.coalesce("p", "prior", F.lit(0.0))))
    gap = F.col("p") - F.col("label")
    per_fold = scored.groupBy("trial", "edge1", "edge2", "fold").agg(F.avg(gap * gap).alias("brier_score"))
    return per_fold.groupBy("trial", "edge1", "edge2").agg(F.avg("brier_score").alias("brier_score"))


def k_sweep(
    table: DataFrame,
    labels: DataFrame,
    ks: Sequence[int],
    *,
    folds: int = 5,
    horizon_seconds: float = HORIZON_SECONDS,
    success_state: int = SUCCESS_STATE,
    seed: int = 42,
) -> DataFrame:
    """Mean Brier score of the clustered model per cluster count: k, brier_score.

    All k-means models are fitted in shared passes over one matrix of journeys.
    """
    table = settle(table)
    features = settle(segments.journey_features(table, segments.top_states(table)).join(labels, "id"))
    columns = segments.cluster_columns(features.drop("label", "fold"))
    assigned = many_means.many_segments(features, columns, ks, folds, seed=seed)
    return segment_sweep(table, assigned, ks, folds=folds, horizon_seconds=horizon_seconds, success_state=success_state)


def segment_sweep(
    table: DataFrame,
    assigned: DataFrame,
    ks: Sequence[int],
    *,
    folds: int = 5,
    horizon_seconds: float = HORIZON_SECONDS,
    success_state: int = SUCCESS_STATE,
) -> DataFrame:
    """Mean Brier score per k from ``assigned`` (id, current_state, label, fold, segments), one segment for every k and fold in that order.

    A journey's moves are counted once, then for every model that trains on it; one aggregation makes the totals of all models, and the
    totals of a fold's whole training set stand in for segments without journeys.
    """
    ks = sorted(ks)
    models = F.array(*[F.struct(F.lit(f"{k}|{f}|").alias("name"), F.lit(f).alias("held")) for k in ks for f in range(folds)])
    named = F.zip_with(models, "segments", lambda m, s: F.struct(m["held"].alias("held"), F.concat(m["name"], s.cast("string")).alias("segment")))
    whole = F.transform(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: F.struct(f.alias("held"), F.concat(F.lit("all|"), f.cast("string")).alias("segment")))
    trains = F.filter(F.concat(named, whole), lambda m: m["held"] != F.col("fold"))
    moves = R.moves(table).groupBy("id", F.col("state").alias("from_state"), F.col("next_state").alias("to_state")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("dt_us").alias("dwell_us")
    )
    spread = moves.join(assigned.select("id", trains.alias("trains")), "id").withColumn("segment", F.explode("trains.segment"))
    totals = settle(
        spread.groupBy("segment", "from_state", "to_state").agg(F.sum("n").alias("n"), F.sum("dwell_us").alias("dwell_us"))
    )
    hits = settle(scoring.horizon_table(R.with_rates(totals), success_state=success_state, horizon_seconds=horizon_seconds))
    priors = settle(R.success_prior(totals, success_state))
    held = assigned.select("current_state", "label", "fold", F.explode(F.filter(named, lambda m: m["held"] == F.col("fold"))["segment"]).alias("segment"))
    # Equal cases score alike: they are counted before they meet the models.
    cases = held.groupBy("fold", "segment", "current_state", "label").agg(F.count(F.lit(1)).alias("n"))
    cases = cases.withColumn("whole", F.concat(F.lit("all|"), F.col("fold").cast("string")))
    for place in ("segment", "whole"):
        cases = scoring.look_up(cases, hits, F.lit(None).cast("double"), segment=place, value="p").withColumnRenamed("p", f"p_{place}")
        cases = cases.join(priors.select(F.col("segment").alias(place), F.col("prior").alias(f"prior_{place}")), place, "left")
    p = clip(F.coalesce("p_segment", "prior_segment", "p_whole", "prior_whole", F.lit(0.0)))
    gap = p - F.col("label")
    per_fold = cases.groupBy(F.split("segment", r"\|")[0].cast("int").alias("k"), "fold").agg((F.sum(F.col("n") * gap * gap) / F.sum("n")).alias("brier_score"))
    return per_fold.groupBy("k").agg(F.avg("brier_score").alias("brier_score"))


def rule_comparison(
    log: JourneyLog,
    taken: DataFrame,
    *,
    clusters: int | None = None,
    horizon_seconds: float = HORIZON_SECONDS,
    test_share: float = 0.25,
    success_state: int = SUCCESS_STATE,
    seed: int = 42,
) -> DataFrame:
    """Probability rule (P >= 1/2) against waiting-time rule (expected time <= horizon).

    ``taken`` holds one prefix snapshot per resolved journey (position_snapshots with action counts
    when ``clusters`` is given).  One row of metrics per method.
    """
    taken = settle(taken)
    split = settle(evaluate.stratified_split(taken.select("id", "label"), test_share, seed=seed))
    train_ids = split.where(~F.col("is_test"))
    table = transitions.transitions_of(log, train_ids, states=None)
    if clusters is not None:
        table = settle(table)
    totals = scoring.fitted_totals(table)
    held = taken.join(split.where("is_test").select("id"), "id", "left_semi").withColumnRenamed(
        "current_last_action", "current_state"
    )
    base = held.select("id", "label", "current_state")
    parts = {
        "global_probability": scoring.horizon_score(
            base, totals, success_state=success_state, horizon_seconds=horizon_seconds
        ),
        "global_waiting_time": scoring.hitting_time(base, totals, success_state=success_state),
    }
    if clusters is not None:
        actions = segments.top_states(table)
        fit_rows = settle(segments.journey_features(table, actions))
        columns = [c for c in segments.cluster_columns(fit_rows)]
        fitted = segments.fit_kmeans(fit_rows, columns, clusters, seed=seed)
        tagged = table.join(fitted.assign(fit_rows).select("id", "segment"), "id")
        per_segment = scoring.fitted_totals(tagged, F.col("segment"))
        ready = segments.snapshot_cluster_features(
            taken.join(split.where("is_test").select("id"), "id", "left_semi"), actions
        )
        assigned = fitted.assign(ready.select("id", "label", *dict.fromkeys([*columns, "current_state"])))
        assigned = settle(assigned.select("id", "label", "current_state", "segment"))
        parts["clustered_probability"] = scoring.segment_score(
            assigned, per_segment, totals, success_state=success_state, horizon_seconds=horizon_seconds
        ).drop("segment")
        parts["clustered_waiting_time"] = scoring.segment_hitting_time(assigned, per_segment, totals).drop("segment")
    long: DataFrame | None = None
    for name, part in parts.items():
        if "seconds" in part.columns:
            score = scoring.waiting_score(F.col("seconds"), horizon_seconds)
            guess = F.col("seconds") <= F.lit(float(horizon_seconds))
        else:
            score, guess = F.col("p"), F.col("p") >= 0.5
        rows = part.select(F.lit(name).alias("method"), "id", "label", score.alias("p"), guess.cast("int").alias("predicted"))
        long = rows if long is None else long.unionByName(rows)
    long = settle(long)
    return evaluate.all_metrics(long, "method").join(evaluate.threshold_metrics(long, "method"), "method")


def position_snapshots_for_rules(log: JourneyLog, actions: Sequence[int], horizon_seconds: float) -> DataFrame:
    return snapshots.position_snapshots(
        log, snapshots.random_cut(F.col("n")), actions=actions, milestones={}, horizon_seconds=horizon_seconds
    )


def scaled_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(id, features) standardised for neighbour search."""
    return segments.feature_array(df, columns, fit_scaling(df, columns))
