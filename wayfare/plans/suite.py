"""The full scoring suite: every model fitted once, all scores of the open journeys in one long table."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.constants import (
    FAILURE_STATE,
    HORIZON_SECONDS,
    PIECEWISE_EDGES_SECONDS,
    SUCCESS_EVENT,
    SUCCESS_STATE,
    TEST_PREVALENCE,
    TIMEOUT_SECONDS,
    TRAIN_PREVALENCE,
)
from wayfare.functions.columns import shift_prevalence
from wayfare.operators import assemble, encode, segments, snapshots, transitions
from wayfare.operators import rates as R
from wayfare.operators import scoring
from wayfare.plans.sweeps import scaled_features
from wayfare.session import settle
from wayfare.sources.log import JourneyLog

MODELS = (
    "global",
    "clustered",
    "timeout",
    "semi_markov",
    "blend",
    "spectral",
    "temporal",
    "order_2",
    "order_3",
    "truncated_kmeans",
    "truncated_spectral",
)
BLENDED = ("global", "clustered", "timeout", "semi_markov")


def score_suite(
    log: JourneyLog,
    *,
    models: Sequence[str] = MODELS,
    clusters: int = 3,
    horizon_seconds: float = HORIZON_SECONDS,
    timeout_seconds: float = TIMEOUT_SECONDS,
    label_horizon_seconds: float = HORIZON_SECONDS,
    edges: Sequence[float] = PIECEWISE_EDGES_SECONDS,
    success_event: str = SUCCESS_EVENT,
    max_samples: int = 60,
    train_prevalence: float = TRAIN_PREVALENCE,
    test_prevalence: float | None = TEST_PREVALENCE,
) -> DataFrame:
    """(id, model, p) for the journeys still open, calibrated to the target prevalence.

    The transition tables are written once and shared by all fits.  Each fit leaves a
    vocabulary-sized table; scoring joins that to the open journeys.
    """
    unknown = sorted(set(models) - set(MODELS))
    if unknown:
        raise ValueError(f"unknown models: {unknown}")
    needed = set(models) | (set(BLENDED) if "blend" in models else set())
    plain = settle(transitions.transitions(log))
    failing = settle(
        transitions.timeout_transitions(log, timeout_seconds=timeout_seconds, horizon_seconds=label_horizon_seconds)
    )
    opened = settle(assemble.open_journeys(log, horizon_seconds=label_horizon_seconds))
    base = opened.select("id", "current_state")
    first = scoring.fitted_totals(plain)
    absorbing = scoring.timeout_totals(failing)
    scores: dict[str, DataFrame] = {}

    # The snapshot models and the segments share nothing but what is written above, so they are fitted beside the rest.
    with ThreadPoolExecutor(2) as beside:
        truncated = beside.submit(
            inheritable_thread_target(log.events.sparkSession)(_truncated),
            log,
            base,
            needed,
            clusters=clusters,
            timeout_seconds=timeout_seconds,
            label_horizon_seconds=label_horizon_seconds,
            success_event=success_event,
            max_samples=max_samples,
        )
        segmented = beside.submit(
            inheritable_thread_target(log.events.sparkSession)(_segmented),
            log,
            base,
            needed,
            plain,
            failing,
            first,
            absorbing,
            clusters=clusters,
            horizon_seconds=horizon_seconds,
        )
        if "global" in needed:
            scores["global"] = scoring.horizon_score(base, first, horizon_seconds=horizon_seconds)
        if "timeout" in needed:
            scores["timeout"] = scoring.timeout_score(base, absorbing)
        if "semi_markov" in needed:
            weights = scoring.fitted_weights(failing, timeout_seconds=timeout_seconds)
            scores["semi_markov"] = scoring.semi_markov_score(base, weights)
        if "temporal" in needed:
            cells = settle(R.piecewise_cells(failing, edges))
            fitted_rates = settle(R.piecewise_from_cells(cells, len(edges) + 1))
            share = R.terminal_share(cells.withColumn("segment", F.lit(R.GLOBAL))).select("fallback").scalar()
            scores["temporal"] = scoring.piecewise_score(
                opened, fitted_rates, edges, F.coalesce(share, F.lit(0.0)), horizon_seconds=horizon_seconds
            )
        for k in (2, 3):
            if f"order_{k}" in needed:
                totals = scoring.fitted_totals(transitions.order_k_transitions(log, k))
                last = transitions.order_k_history(log, k).join(base.select("id"), "id", "left_semi").groupBy("id").agg(
                    F.max_by("ed_id", "seq").alias("current_state"),
                    transitions.history_key(F.max_by("history", "seq")).alias("history"),
                )
                scores[f"order_{k}"] = scoring.order_k_score(last, totals, first, k, horizon_seconds=horizon_seconds)
        scores |= segmented.result() | truncated.result()
    scores = {name: scores[name] for name in MODELS if name in scores}

    long: DataFrame | None = None
    for name, part in scores.items():
        rows = part.select("id", F.lit(name).alias("model"), "p")
        long = rows if long is None else long.unionByName(rows)
    if "blend" in models:
        long = settle(long)
        mixed = long.where(F.col("model").isin(*BLENDED)).groupBy("id").agg(F.avg("p").alias("p"))
        long = long.unionByName(mixed.select("id", F.lit("blend").alias("model"), "p"))
    long = long.where(F.col("model").isin(*models))
    if test_prevalence is not None:
        long = long.withColumn("p", shift_prevalence(F.col("p"), train=train_prevalence, test=test_prevalence))
    return long


def _segmented(log, base, needed, plain, failing, first, absorbing, *, clusters, horizon_seconds):
    """Models on segments of journeys."""
    out: dict[str, DataFrame] = {}
    if not needed & {"clustered", "spectral"}:
        return out
    actions = segments.top_states(plain)
    features = settle(segments.journey_features(plain, actions))
    open_log = log.of(base).states(transitions.CUSTOMER_STATES, also=28)
    open_features = settle(segments.journey_features_open(open_log, actions))
    columns = segments.cluster_columns(features)
    if "clustered" in needed:
        fitted = segments.fit_kmeans(features, columns, clusters)
        totals = scoring.fitted_totals(plain.join(fitted.assign(features).select("id", "segment"), "id"), F.col("segment"))
        rows = fitted.assign(open_features).select("id", "current_state", "segment")
        out["clustered"] = scoring.segment_score(rows, totals, first, horizon_seconds=horizon_seconds)
    if "spectral" in needed:
        stable = segments.cluster_columns(features, spectral=True)
        both = features.select("id", *stable).withColumn("_open", F.lit(0)).unionByName(
            open_features.select(F.concat(F.lit("open:"), "id").alias("id"), *stable).withColumn("_open", F.lit(1))
        )
        tags = _spectral_tags(both, stable, clusters)
        failing_tagged = failing.join(tags, "id")
        totals = scoring.timeout_totals(failing_tagged, F.col("segment"))
        rows = base.join(
            tags.where(F.col("id").startswith("open:")).select(F.substring("id", 6, 1_000).alias("id"), "segment"), "id"
        )
        out["spectral"] = scoring.segment_timeout_score(rows, totals, absorbing)
    return out


def _spectral_tags(both: DataFrame, columns: Sequence[str], clusters: int) -> DataFrame:
    """Segments fitted on the training rows, voted for all rows."""
    scaling = encode.fit_scaling(both.where(F.col("_open") == 0), columns)
    ready = settle(
        scaling.apply(both).select("id", "_open", F.array(*[F.col(c).cast("double") for c in columns]).alias("features"))
    )
    train = ready.where(F.col("_open") == 0).select("id", "features")
    labels = segments.fit_spectral(train, clusters)
    return settle(segments.vote(ready.select("id", "features"), labels.base, labels.segments))


def snapshot_frame(df: DataFrame, categories: dict[str, list[str]]) -> DataFrame:
    """Numeric snapshot features with one-hot names, keyed by snapshot_id as ``id``."""
    names = ["first_event_name", "last_event_name", *[f"last{i}_event" for i in range(1, 6)]]
    out = df
    for c in names:
        out = encode.one_hot(out, c, categories[c])
    dropped = {
        "id", "sample_num", "snapshot_id", "journey_status", "source_table", "label", "cutoff_us",
        "snapshot_us", "first_event_us", "last_event_us", *names,
    }
    numeric = [c for c in out.columns if c not in dropped]
    return out.select(F.col("snapshot_id").alias("id"), *[F.col(c).cast("double").alias(c) for c in numeric])


def _truncated(log, base, needed, *, clusters, timeout_seconds, label_horizon_seconds, success_event, max_samples):
    """Models on leakage-safe snapshots: segments of snapshots, generators of what follows them."""
    if not needed & {"truncated_kmeans", "truncated_spectral"}:
        return {}
    labeled = settle(assemble.labeled_journeys(log, horizon_seconds=label_horizon_seconds))
    names = snapshots.vocabulary(snapshots.top_events(log.events, labeled, success_event=success_event), "event_name")
    taken = settle(
        snapshots.realistic_snapshots(
            log, names, success_event=success_event, max_samples=max_samples, horizon_seconds=label_horizon_seconds
        )
    )

    def totals_of(tags: DataFrame | None = None, names: Sequence[str] | None = None) -> DataFrame:
        """Absorbing totals of what follows the snapshots, by segment; the walks themselves are never stored."""
        tagged = taken if tags is None else taken.join(tags, "snapshot_id")
        found = transitions.suffix_totals(log, tagged, segments=names, timeout_seconds=timeout_seconds)
        return settle(found.where(~F.col("from_state").isin(SUCCESS_STATE, FAILURE_STATE)))

    names_of = [str(i) for i in range(clusters)]
    opened = log.of(base)
    open_rows = settle(snapshots.open_snapshots(opened, names, success_event=success_event))
    text = ["first_event_name", "last_event_name", *[f"last{i}_event" for i in range(1, 6)]]
    categories = {c: encode.fit_categories(taken, c) for c in text}
    train = settle(snapshot_frame(taken, categories))
    test = settle(snapshot_frame(open_rows, categories))
    columns = [c for c in train.columns if c != "id"]
    states = open_rows.select("id", "snapshot_id", "current_state")
    out = {}

    def spectral_totals() -> tuple[DataFrame, DataFrame]:
        both = train.withColumn("_open", F.lit(0)).unionByName(test.withColumn("_open", F.lit(1)))
        tags = _spectral_tags(both, columns, clusters).withColumnRenamed("id", "snapshot_id")
        return tags, totals_of(tags, names_of)

    # The graph of the snapshots takes longest; the rest is fitted beside it.
    with ThreadPoolExecutor(1) as beside:
        spectral = beside.submit(inheritable_thread_target(log.events.sparkSession)(spectral_totals)) if "truncated_spectral" in needed else None
        whole = totals_of()
        if "truncated_kmeans" in needed:
            fitted = segments.fit_kmeans(train, columns, clusters)
            tags = fitted.assign(train).select(F.col("id").alias("snapshot_id"), "segment")
            open_tags = fitted.assign(test).select(F.col("id").alias("snapshot_id"), "segment")
            totals = totals_of(tags, names_of)
            out["truncated_kmeans"] = scoring.segment_timeout_score(states.join(open_tags, "snapshot_id"), totals, whole)
        if spectral is not None:
            tags, totals = spectral.result()
            out["truncated_spectral"] = scoring.segment_timeout_score(states.join(tags, "snapshot_id"), totals, whole)
    return out


__all__ = ["MODELS", "score_suite", "snapshot_frame", "scaled_features"]
