"""Registered queries: journey features and segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfare.operators import neighbours, segments, snapshots, transitions
from wayfare.plans import sql
from wayfare.plans.catalog_snapshots import FRAC, numbered
from wayfare.plans.catalog_transitions import ev_transitions
from wayfare.plans.registry import query, r6
from wayfare.plans.sql import CUSTOMER28, EV, OL_LABEL, recursive, with_
from wayfare.plans.sweeps import scaled_features
from wayfare.session import settle
from wayfare.sources import adapters

ACTIONS = [2, 4, 23, 28]
NEIGHBOURS = 10


def actions_of(spark, folder):
    """Top states of the log, in id order (the vocabulary of the given table)."""
    return sorted(segments.top_states(ev_transitions(spark, folder)))


@query(
    "journey_features",
    with_(EV, sql.transitions("ev"))
    + """SELECT id, count(*) AS num_transitions, round(sum(dt_us) / 1e6, 6) AS total_observed_time, round(sum(dt_us) / 1e6 / count(*), 6) AS avg_gap_seconds,
  arg_min(state, seq) AS first_state, arg_max(next_state, seq) AS current_state, """
    + ", ".join(
        f"count(*) FILTER (state = {a}) AS action_count_{a}, round(count(*) FILTER (state = {a}) / (count(*) + 1), 6) AS action_prop_{a}, "
        f"round(coalesce(sum(dt_us) FILTER (state = {a}), 0) / 1e6, 6) AS time_in_state_{a}"
        for a in ACTIONS
    )
    + """, round(coalesce(min(cum) FILTER (next_state = 28), -1e6) / 1e6, 6) AS time_to_action_28, (bool_or(next_state = 28))::INT AS seen_action_28
FROM (SELECT *, sum(dt_us) OVER (PARTITION BY id ORDER BY seq)::BIGINT AS cum FROM tr) GROUP BY id""",
)
def _(spark, folder):
    table = ev_transitions(spark, folder)
    return r6(segments.journey_features(table, actions_of(spark, folder)))


@query(
    "journey_features_open",
    with_(
        EV,
        f"""g AS (SELECT *, coalesce(ts_us - lag(ts_us) OVER w, 0) AS gap, row_number() OVER w AS seq FROM ev WHERE ed_id IN {CUSTOMER28}
  WINDOW w AS (PARTITION BY id ORDER BY ts_us, ed_id))""",
    )
    + """SELECT id, count(*) - 1 AS num_transitions, round(sum(gap) / 1e6, 6) AS total_observed_time, round(sum(gap) / 1e6 / greatest(count(*) - 1, 1), 6) AS avg_gap_seconds,
  arg_min(ed_id, seq) AS first_state, arg_max(ed_id, seq) AS current_state, """
    + ", ".join(
        f"count(*) FILTER (ed_id = {a}) AS action_count_{a}, round(count(*) FILTER (ed_id = {a}) / count(*), 6) AS action_prop_{a}, "
        f"round(coalesce(sum(gap) FILTER (ed_id = {a}), 0) / 1e6, 6) AS time_in_state_{a}"
        for a in ACTIONS
    )
    + """, round(coalesce(min(cum) FILTER (ed_id = 28), -1e6) / 1e6, 6) AS time_to_action_28, (bool_or(ed_id = 28))::INT AS seen_action_28
FROM (SELECT *, sum(gap) OVER (PARTITION BY id ORDER BY seq)::BIGINT AS cum FROM g) GROUP BY id""",
)
def _(spark, folder):
    log = adapters.events_log(spark, folder).states(transitions.CUSTOMER_STATES, also=28)
    return r6(segments.journey_features_open(log, actions_of(spark, folder)))


SNAP_ACTIONS = [28, 11, 6, 4, 5, 2]


@query(
    "snapshot_cluster_features",
    with_(
        OL_LABEL,
        numbered("ol"),
        f"px AS (SELECT nb.*, journey_status FROM nb JOIN lb USING (id) WHERE pos <= {FRAC} AND journey_status IN ('successful', 'incomplete'))",
    )
    + """SELECT id, (any_value(journey_status) = 'successful')::INT AS label, count(*) - 1 AS num_transitions,
  ((max(ts_us) - min(ts_us)) // 1000000)::DOUBLE AS total_observed_time,
  round(CASE WHEN count(*) > 1 THEN ((max(ts_us) - min(ts_us)) // 1000000) / (count(*) - 1) ELSE 0 END, 6) AS avg_gap_seconds,
  arg_min(ed_id, pos) AS first_state, arg_max(ed_id, pos) AS current_state, """
    + ", ".join(
        f"count(*) FILTER (ed_id = {a}) AS action_count_{a}, round(count(*) FILTER (ed_id = {a}) / count(*), 6) AS action_prop_{a}, "
        f"round(((max(ts_us) - min(ts_us)) // 1000000)::DOUBLE * count(*) FILTER (ed_id = {a}) / count(*), 6) AS time_in_state_{a}"
        for a in SNAP_ACTIONS
    )
    + ", -1.0::DOUBLE AS time_to_action_28, (bool_or(ed_id = 28))::INT AS seen_action_28 FROM px GROUP BY id",
)
def _(spark, folder):
    log = adapters.orders_log(spark, folder)
    taken = snapshots.position_snapshots(log, snapshots.fraction_cut(F.col("n")), actions=SNAP_ACTIONS, milestones={})
    return r6(segments.snapshot_cluster_features(taken, SNAP_ACTIONS))


def fitted_kmeans(spark, folder, k=3):
    table = ev_transitions(spark, folder)
    features = settle(segments.journey_features(table, segments.top_states(table)))
    return features, segments.fit_kmeans(features, segments.cluster_columns(features), k)


@query("kmeans_segments")
def _(spark, folder):
    features, fitted = fitted_kmeans(spark, folder)
    return fitted.assign(features).select("id", "segment")


@query("cluster_summary")
def _(spark, folder):
    features, fitted = fitted_kmeans(spark, folder)
    return segments.segment_summary(fitted.assign(features))


@query("assign_segments")
def _(spark, folder):
    features, fitted = fitted_kmeans(spark, folder)
    log = adapters.events_log(spark, folder).states(transitions.CUSTOMER_STATES, also=28)
    actions = [int(c.rsplit("_", 1)[1]) for c in features.columns if c.startswith("action_count_")]
    return fitted.assign(segments.journey_features_open(log, actions)).select("id", "segment")


SHARES = [f"action_prop_{a}" for a in ACTIONS]
# Centres: mean shares of the journeys that start in the same state.  Open journeys are assigned to the same centres.
CENTRES = with_(
    EV,
    sql.transitions("ev"),
    "jf AS (SELECT id, arg_min(state, seq) AS first_state, " + ", ".join(f"count(*) FILTER (state = {a}) / (count(*) + 1) AS action_prop_{a}" for a in ACTIONS) + " FROM tr GROUP BY id)",
    f"""oj AS (SELECT id, {", ".join(f"count(*) FILTER (ed_id = {a}) / count(*) AS action_prop_{a}" for a in ACTIONS)} FROM ev WHERE ed_id IN {CUSTOMER28} GROUP BY id)""",
    "ce AS (SELECT CAST(first_state AS VARCHAR) AS segment, " + ", ".join(f"avg({c}) AS {c}" for c in SHARES) + " FROM jf GROUP BY 1)",
)


def nearest_sql(rows: str) -> str:
    square = " + ".join(f"(r.{c} - ce.{c}) ** 2" for c in SHARES)
    return f"SELECT id, arg_min(segment, (d, segment)) AS segment FROM (SELECT r.id, ce.segment, round({square}, 9) AS d FROM {rows} r, ce) GROUP BY id"


def centred(spark, folder):
    features = settle(segments.journey_features(ev_transitions(spark, folder), ACTIONS).select("id", "first_state", *SHARES))
    return features, segments.group_centres(features, SHARES, "first_state")


@query("centre_segments", CENTRES + nearest_sql("jf"))
def _(spark, folder):
    features, centres = centred(spark, folder)
    return segments.nearest_centre(features, SHARES, centres).select("id", "segment")


@query("centre_segments_open", CENTRES + nearest_sql("oj"))
def _(spark, folder):
    _, centres = centred(spark, folder)
    log = adapters.events_log(spark, folder).states(transitions.CUSTOMER_STATES, also=28)
    return segments.nearest_centre(segments.journey_features_open(log, ACTIONS), SHARES, centres).select("id", "segment")


@query("centre_summary", CENTRES + f"SELECT segment, count(*) AS n_rows FROM ({nearest_sql('jf')}) GROUP BY segment")
def _(spark, folder):
    features, centres = centred(spark, folder)
    return segments.segment_summary(segments.nearest_centre(features, SHARES, centres))


@query("spectral_segments")
def _(spark, folder):
    table = ev_transitions(spark, folder)
    features = settle(segments.journey_features(table, segments.top_states(table)))
    columns = segments.cluster_columns(features, spectral=True)
    return segments.spectral_segments(settle(scaled_features(features, columns)), 3)


def vectors(spark, folder):
    return spark.read.parquet(f"{folder}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("features")
    )


KNN = f"""v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
d AS (SELECT a.id, b.id AS neighbour, list_distance(a.x, b.x) AS distance FROM v a JOIN v b ON a.id <> b.id),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS rank FROM d),
nn AS (SELECT * FROM k WHERE rank <= {NEIGHBOURS})"""


@query("nearest_neighbours", with_(KNN) + "SELECT id, neighbour, rank, round(distance, 6) AS distance FROM nn")
def _(spark, folder):
    rows = vectors(spark, folder)
    return r6(neighbours.nearest_neighbours(rows, rows, NEIGHBOURS, exclude_self=True))


@query(
    "knn_components",
    recursive(
        KNN.replace(f"rank <= {NEIGHBOURS}", "rank <= 1"),
        "e AS (SELECT id AS a, neighbour AS b FROM nn UNION SELECT neighbour, id FROM nn)",
        "r AS (SELECT id AS node, id AS seen FROM v UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)",
    )
    + "SELECT node, min(seen) AS component FROM r GROUP BY node",
)
def _(spark, folder):
    # One neighbour each: the graph falls into many components.
    rows = vectors(spark, folder)
    edges = neighbours.neighbour_edges(rows, 1)
    return neighbours.components(edges, rows.select(F.col("id").alias("node")))
