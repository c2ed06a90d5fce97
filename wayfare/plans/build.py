"""From raw events to the prepared tables, in one call."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.constants import HORIZON_SECONDS, MAX_SAMPLES_PER_JOURNEY, SUCCESS_EVENT, SUCCESS_STATE, TOP_N_ACTIONS
from wayfare.operators import assemble, segments, snapshots, transitions
from wayfare.operators import scoring
from wayfare.sources.log import JourneyLog
from wayfare.sources.writers import write_parquet

# Tables split by outcome are partitioned by it, so reading one outcome skips the others' files.
PARTITIONED = {"labeled": ("journey_status",), "realistic": ("journey_status",)}


def prepared_tables(
    log: JourneyLog,
    *,
    horizon_seconds: float = HORIZON_SECONDS,
    success_state: int = SUCCESS_STATE,
    success_event: str = SUCCESS_EVENT,
    max_samples: int = MAX_SAMPLES_PER_JOURNEY,
    top_n: int = TOP_N_ACTIONS,
) -> dict[str, DataFrame]:
    """Plans of all prepared tables: flattened, labeled, training, timed, realistic, open.

    The two top lists that fix the count columns are short and read at planning time.
    """
    labeled = assemble.labeled_journeys(log, success_state=success_state, horizon_seconds=horizon_seconds)
    actions = snapshots.vocabulary(snapshots.top_actions(log.events, n=top_n), "ed_id")
    names = snapshots.vocabulary(snapshots.top_events(log.events, labeled, success_event=success_event), "event_name")
    outcome = {"success_state": success_state, "horizon_seconds": horizon_seconds}
    still_open = log.of(labeled.where(F.col("journey_status") == "other"))
    return {
        "flattened": assemble.journey_parts(log),
        "labeled": labeled,
        "training": snapshots.position_snapshots(log, snapshots.random_cut(F.col("n")), actions=actions, **outcome),
        "timed": snapshots.time_snapshots(log, max_samples=max_samples, actions=actions, **outcome),
        "realistic": snapshots.realistic_snapshots(
            log, names, max_samples=max_samples, success_event=success_event, **outcome
        ),
        "open": snapshots.open_snapshots(still_open, names, success_event=success_event),
    }


def build_tables(log: JourneyLog, folder: str, **options) -> Mapping[str, str]:
    """Write the prepared tables below ``folder``; returns their paths."""
    paths = {}
    for name, table in prepared_tables(log, **options).items():
        paths[name] = f"{folder}/{name}"
        write_parquet(table, paths[name], partition_by=PARTITIONED.get(name, ()))
    return paths


def model_bundle(log: JourneyLog, *, clusters: int = 4) -> dict[str, DataFrame]:
    """Transitions, journey features, segments, and global and per-segment totals for exploration."""
    table = transitions.transitions(log)
    features = segments.journey_features(table, segments.top_states(table))
    fitted = segments.fit_kmeans(features, segments.cluster_columns(features), clusters)
    tags = fitted.assign(features).select("id", "segment")
    return {
        "transitions": table,
        "features": features,
        "segments": tags,
        "global_totals": scoring.fitted_totals(table),
        "segment_totals": scoring.fitted_totals(table.join(tags, "id"), F.col("segment")),
    }
