"""Registered queries: prefix snapshots and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfare.constants import MILESTONES
from wayfare.operators import assemble, encode, snapshots
from wayfare.plans import sql
from wayfare.plans.registry import query, r6
from wayfare.plans.sql import DAY, EV, EV_LABEL, OL, OL_LABEL, with_
from wayfare.session import settle
from wayfare.sources import adapters

H12 = 43_200
EV_ACTIONS = [4, 2, 28, 23, 12]
OL_ACTIONS = [28, 11, 6, 4, 5, 2]
EV_NAMES = ["click", "error", "signup", "view"]
OL_NAMES = ["add_to_cart", "begin_checkout", "browse_products", "campaign_click", "view_cart"]


def ev(spark, folder):
    log = adapters.events_log(spark, folder)
    return log, assemble.labeled_journeys(log, horizon_seconds=H12)


def ol(spark, folder):
    log = adapters.orders_log(spark, folder)
    return log, assemble.labeled_journeys(log)


def numbered(log: str) -> str:
    return f"""nb AS (SELECT *, row_number() OVER w AS pos, lag(ts_us) OVER w AS prev_us, count(*) OVER (PARTITION BY id) AS n
  FROM {log} WINDOW w AS (PARTITION BY id ORDER BY ts_us, ed_id))"""


FRAC = "CASE WHEN n <= 1 THEN 1 ELSE greatest(1, least(n - 1, floor(0.7 * n))) END"
RAND = f"CASE WHEN n <= 1 THEN 1 ELSE least(n - 1, 1 + floor({sql.uniform(42, 'id')} * (n - 1))) END"

# Features of the prefix of k events, grouped by {key}; rows come from {src} with k attached.
PREFIX = """SELECT {key}, max(n) AS full_num_actions, count(*) AS snapshot_num_actions,
  arg_min(ed_id, pos) AS first_action_so_far, arg_max(ed_id, pos) AS current_last_action,
  count(DISTINCT ed_id) AS num_unique_actions_so_far,
  (max(ts_us) - min(ts_us)) // 1000000 AS prefix_duration_seconds,
  CASE WHEN count(*) > 1 THEN (arg_max(ts_us, pos) - arg_max(prev_us, pos)) // 1000000 ELSE 0 END AS time_since_prev_action_seconds
FROM {src} GROUP BY {key}"""


@query(
    "snapshot_frac",
    with_(OL, numbered("ol"))
    + f"""SELECT id, (pos - 1) // 6 AS part, {FRAC}::BIGINT AS snapshot_num_actions,
  string_agg(ed_id::VARCHAR, '>' ORDER BY pos) AS prefix FROM nb WHERE pos <= {FRAC} GROUP BY id, part, n""",
)
def _(spark, folder):
    log = adapters.orders_log(spark, folder)
    summary = assemble.journey_summary(log).select(
        "id", snapshots.fraction_cut(F.col("num_actions")).alias("snapshot_num_actions")
    )
    parts = snapshots.prefix_action_parts(log, summary, part_rows=6)
    text = F.concat_ws(">", F.transform("prefix_actions", lambda x: x.cast("string"))).alias("prefix")
    return parts.select("id", "part", "snapshot_num_actions", text)


@query(
    "snapshot_random",
    with_(EV_LABEL, numbered("ev"), "rs AS (SELECT nb.* FROM nb JOIN lb USING (id) WHERE journey_status IN ('successful', 'incomplete'))")
    + PREFIX.format(key="id", src=f"(SELECT * FROM rs WHERE pos <= {RAND})"),
)
def _(spark, folder):
    log = adapters.events_log(spark, folder)
    out = snapshots.position_snapshots(log, snapshots.random_cut(F.col("n")), milestones={}, horizon_seconds=H12)
    return out.select(
        "id", "full_num_actions", "snapshot_num_actions", "first_action_so_far", "current_last_action",
        "num_unique_actions_so_far", "prefix_duration_seconds", "time_since_prev_action_seconds",
    )


@query(
    "prefix_features",
    with_(OL_LABEL, numbered("ol"), "rs AS (SELECT nb.* FROM nb JOIN lb USING (id) WHERE journey_status IN ('successful', 'incomplete'))")
    + f"""SELECT p.*, round(snapshot_num_actions / full_num_actions, 6) AS snapshot_frac_of_journey,
  round(CASE WHEN snapshot_num_actions > 1 THEN prefix_duration_seconds / (snapshot_num_actions - 1) ELSE 0 END, 6) AS avg_gap_seconds,
  (journey_status = 'successful')::INT AS label, journey_status AS final_outcome
FROM ({PREFIX.format(key="id", src=f"(SELECT * FROM rs WHERE pos <= {FRAC})")}) p JOIN lb USING (id)""",
)
def _(spark, folder):
    log = adapters.orders_log(spark, folder)
    out = snapshots.position_snapshots(log, snapshots.fraction_cut(F.col("n")), milestones={})
    return r6(out.drop("snapshot_us", "remaining_seconds", "action_entropy", "max_action_repeat"))


@query(
    "remaining_time",
    with_(OL_LABEL, numbered("ol"))
    + f"""SELECT nb.id, (journey_status = 'successful')::INT AS label, ts_us AS snapshot_us,
  round(CASE WHEN journey_status = 'successful' THEN (end_us - ts_us) / 1e6 END, 6) AS remaining_seconds
FROM nb JOIN lb USING (id) WHERE pos = {FRAC} AND journey_status IN ('successful', 'incomplete')""",
)
def _(spark, folder):
    log = adapters.orders_log(spark, folder)
    out = snapshots.position_snapshots(log, snapshots.fraction_cut(F.col("n")), milestones={})
    return r6(out.select("id", "label", "snapshot_us", "remaining_seconds"))


# Time samples sa(id, sample_num, cutoff_us, label, ...) of resolved journeys.
TIME_SAMPLES = f"""sa AS (
  SELECT l.*, k AS sample_num, start_us + floor({sql.uniform(42, "id", "k")} * (end_us - start_us))::BIGINT AS cutoff_us,
         (journey_status = 'successful')::INT AS label
  FROM (SELECT *, least(60, greatest(1, (end_us - start_us + {DAY} - 1) // {DAY})) AS ns FROM lb
        WHERE journey_status IN ('successful', 'incomplete')) l, range(1, 61) r(k) WHERE k <= ns)"""

REAL_SAMPLES = f"""sa AS (
  SELECT l.*, k AS sample_num, (journey_status = 'successful')::INT AS label,
         start_us + floor({sql.uniform(42, "id", "k")} * CASE WHEN journey_status = 'successful' THEN span * 0.70::DOUBLE ELSE span::DOUBLE END)::BIGINT AS cutoff_us
  FROM (SELECT *, coalesce(completion_us, end_us) - start_us AS span,
          least(60, greatest(1, (coalesce(completion_us, end_us) - start_us + {DAY} - 1) // {DAY})) AS ns FROM lb
        WHERE journey_status IN ('successful', 'incomplete') AND coalesce(completion_us, end_us) > start_us) l, range(1, 61) r(k) WHERE k <= ns)"""

# Prefix events of every sample.
PREFIX_ROWS = """px AS (SELECT s.id, s.sample_num, s.cutoff_us, s.label, s.journey_status, s.start_us, nb.ed_id, nb.event_name, nb.ts_us, nb.pos, nb.prev_us, nb.n
  FROM sa s JOIN nb ON nb.id = s.id AND nb.ts_us <= s.cutoff_us)"""


@query(
    "snapshot_time",
    with_(EV_LABEL, numbered("ev"), TIME_SAMPLES, PREFIX_ROWS)
    + f"""SELECT *, round(snapshot_num_actions / full_num_actions, 6) AS snapshot_frac_of_journey,
  round(CASE WHEN snapshot_num_actions > 1 THEN prefix_duration_seconds / (snapshot_num_actions - 1) ELSE 0 END, 6) AS avg_gap_seconds
FROM ({PREFIX.format(key="id, sample_num, cutoff_us, label, journey_status", src="px")})""",
)
def _(spark, folder):
    log = adapters.events_log(spark, folder)
    out = snapshots.time_snapshots(log, horizon_seconds=H12, milestones={})
    return r6(out.drop("action_entropy", "max_action_repeat"))


def time_actions(spark, folder, *columns):
    log = adapters.events_log(spark, folder)
    out = snapshots.time_snapshots(log, horizon_seconds=H12, actions=EV_ACTIONS)
    return r6(out.select("id", "sample_num", *columns))


COUNTS = "ct AS (SELECT id, sample_num, ed_id, count(*) AS c, sum(count(*)) OVER (PARTITION BY id, sample_num) AS k FROM px GROUP BY id, sample_num, ed_id)"
TIME_CT = with_(EV_LABEL, numbered("ev"), TIME_SAMPLES, PREFIX_ROWS, COUNTS)


@query(
    "action_counts",
    TIME_CT
    + "SELECT id, sample_num, "
    + ", ".join(f"coalesce(max(c) FILTER (ed_id = {a}), 0) AS action_count_{a}" for a in EV_ACTIONS)
    + " FROM ct GROUP BY id, sample_num",
)
def _(spark, folder):
    return time_actions(spark, folder, *[f"action_count_{a}" for a in EV_ACTIONS])


@query(
    "action_entropy",
    TIME_CT
    + "SELECT id, sample_num, round(greatest(0.0, sum(-(c / k) * log2(c / k))), 6) AS action_entropy FROM ct GROUP BY id, sample_num",
)
def _(spark, folder):
    return time_actions(spark, folder, "action_entropy")


@query("max_repeat", TIME_CT + "SELECT id, sample_num, max(c) AS max_action_repeat FROM ct GROUP BY id, sample_num")
def _(spark, folder):
    return time_actions(spark, folder, "max_action_repeat")


@query(
    "action_props",
    TIME_CT
    + "SELECT id, sample_num, "
    + ", ".join(f"round(coalesce(max(c / k) FILTER (ed_id = {a}), 0), 6) AS action_prop_{a}" for a in EV_ACTIONS)
    + " FROM ct GROUP BY id, sample_num",
)
def _(spark, folder):
    return time_actions(spark, folder, *[f"action_prop_{a}" for a in EV_ACTIONS])


@query(
    "snapshot_milestones",
    TIME_CT
    + "SELECT id, sample_num, "
    + ", ".join(f"max((ed_id = {e})::INT) AS {n}" for n, e in MILESTONES.items())
    + " FROM ct GROUP BY id, sample_num",
)
def _(spark, folder):
    return time_actions(spark, folder, *MILESTONES)


@query(
    "top_actions_in_prefixes",
    with_(EV_LABEL, numbered("ev"), TIME_SAMPLES, PREFIX_ROWS)
    + "SELECT ed_id, count(*) AS n FROM px GROUP BY ed_id ORDER BY n DESC, ed_id LIMIT 20",
)
def _(spark, folder):
    # Occurrences over all prefixes are the sums of the per-snapshot counts.
    log = adapters.events_log(spark, folder)
    # Every id of the log takes part: there are as many as event definitions.
    ids = snapshots.vocabulary(log.events.where("ed_id IS NOT NULL").select("ed_id").distinct().orderBy("ed_id"), "ed_id")
    taken = snapshots.time_snapshots(log, horizon_seconds=H12, actions=ids, milestones={})
    counts = [F.struct(F.lit(a).cast("long").alias("ed_id"), F.sum(f"action_count_{a}").alias("n")) for a in ids]
    long = taken.agg(F.array(*counts).alias("e")).select(F.inline("e"))
    return long.where(F.col("n") > 0).orderBy(F.desc("n"), "ed_id").limit(20)


def clean_sql(log: str, label: str, success: str) -> str:
    """Events without success, numbered, and realistic samples over them."""
    return with_(
        label,
        f"""nb AS (SELECT *, row_number() OVER w AS pos, lag(ts_us) OVER w AS prev_us, count(*) OVER (PARTITION BY id) AS n
  FROM {log} WHERE event_name IS DISTINCT FROM '{success}' WINDOW w AS (PARTITION BY id ORDER BY ts_us, ed_id))""",
        REAL_SAMPLES,
        PREFIX_ROWS,
    )


REALISTIC = """SELECT p.*, x.part, x.prefix FROM (
  SELECT id, sample_num, id || '::' || sample_num AS snapshot_id, journey_status,
    CASE WHEN label = 1 THEN 'complete' ELSE 'incomplete' END AS source_table, label, max(ts_us) AS snapshot_us, count(*) AS num_events,
    arg_max(ed_id, pos) AS current_state FROM px GROUP BY id, sample_num, journey_status, label) p
JOIN (SELECT id, sample_num, (pos - 1) // 16 AS part, string_agg(ed_id::VARCHAR, '>' ORDER BY pos) AS prefix FROM px GROUP BY ALL) x USING (id, sample_num)"""


@query("snapshot_realistic", clean_sql("ev", EV_LABEL, "purchase") + REALISTIC)
def _(spark, folder):
    log = adapters.events_log(spark, folder)
    out = snapshots.realistic_snapshots(log, [], success_event="purchase", horizon_seconds=H12)
    base = ["id", "sample_num", "snapshot_id", "journey_status", "source_table", "label", "snapshot_us", "num_events", "current_state"]
    out = settle(out.select(*base))
    clean = log.where(snapshots.unsuccessful("purchase"))
    parts = snapshots.prefix_action_parts(clean, out, "num_events", part_rows=16)
    text = F.concat_ws(">", F.transform("prefix_actions", lambda x: x.cast("string"))).alias("prefix")
    return out.join(parts.select("snapshot_id", "part", text), "snapshot_id")


def feature_sql(source: str, keys: str, start: str, grouped: str) -> str:
    return f"""SELECT {keys}, num_events, num_unique_event_names, num_unique_ed_ids, first_event_name, last_event_name, first_ed_id, last_ed_id, current_state,
  round((hi - {start}) / 86400e6, 6) AS snapshot_age_days, round((hi - lo) / 86400e6, 6) AS active_span_days, 0.0::DOUBLE AS days_since_last_event,
  round(num_events / ((hi - {start}) / 86400e6 + 1), 6) AS events_per_day_since_start, round(num_events / ((hi - lo) / 86400e6 + 1), 6) AS events_per_active_day,
  round(coalesce(g_avg, 0), 6) AS avg_gap_days, round(coalesce(g_max, 0), 6) AS max_gap_days, round(coalesce(g_std, 0), 6) AS std_gap_days
FROM (SELECT {grouped}, count(*) AS num_events, count(DISTINCT event_name) AS num_unique_event_names, count(DISTINCT ed_id) AS num_unique_ed_ids,
  arg_min(event_name, pos) AS first_event_name, arg_max(event_name, pos) AS last_event_name, arg_min(ed_id, pos) AS first_ed_id, arg_max(ed_id, pos) AS last_ed_id,
  arg_max(ed_id, pos) AS current_state, min(ts_us) AS lo, max(ts_us) AS hi,
  avg((ts_us - prev_us) / 86400e6) AS g_avg, max((ts_us - prev_us) / 86400e6) AS g_max, stddev_pop((ts_us - prev_us) / 86400e6) AS g_std
  FROM {source} GROUP BY {grouped})"""


FEATURES = [
    "num_events", "num_unique_event_names", "num_unique_ed_ids", "first_event_name", "last_event_name", "first_ed_id",
    "last_ed_id", "current_state", "snapshot_age_days", "active_span_days", "days_since_last_event",
    "events_per_day_since_start", "events_per_active_day", "avg_gap_days", "max_gap_days", "std_gap_days",
]


@query(
    "snapshot_features",
    clean_sql("ev", EV_LABEL, "purchase")
    + feature_sql("px", "id, sample_num, label", "start_us", "id, sample_num, label, start_us"),
)
def _(spark, folder):
    log = adapters.events_log(spark, folder)
    out = snapshots.realistic_snapshots(log, [], success_event="purchase", horizon_seconds=H12)
    return r6(out.select("id", "sample_num", "label", *FEATURES))


@query(
    "snapshot_features_orders",
    clean_sql("ol", OL_LABEL, "order_shipped")
    + feature_sql("px", "id, sample_num, label", "start_us", "id, sample_num, label, start_us"),
)
def _(spark, folder):
    log = adapters.orders_log(spark, folder)
    out = snapshots.realistic_snapshots(log, [])
    return r6(out.select("id", "sample_num", "label", *FEATURES))


LASTK = ", ".join(
    f"coalesce(max(event_name) FILTER (pos = top - {i - 1}), 'missing') AS last{i}_event" for i in range(1, 6)
)


@query(
    "last_k_events",
    clean_sql("ol", OL_LABEL, "order_shipped")
    + f"SELECT id, sample_num, {LASTK} FROM (SELECT *, max(pos) OVER (PARTITION BY id, sample_num) AS top FROM px) GROUP BY id, sample_num",
)
def _(spark, folder):
    log = adapters.orders_log(spark, folder)
    out = snapshots.realistic_snapshots(log, [])
    return out.select("id", "sample_num", *[f"last{i}_event" for i in range(1, 6)])


TRAIL = ", ".join(f"count(*) FILTER (hi - ts_us <= {w} * {DAY}::BIGINT) AS events_last_{w}d" for w in (1, 3, 7, 14, 30))


@query(
    "trailing_windows",
    clean_sql("ev", EV_LABEL, "purchase")
    + f"""SELECT *, round(events_last_1d / (events_last_30d + 1), 6) AS recent_1d_to_30d, round(events_last_3d / (events_last_30d + 1), 6) AS recent_3d_to_30d,
  round(events_last_7d / (events_last_30d + 1), 6) AS recent_7d_to_30d
FROM (SELECT id, sample_num, {TRAIL} FROM (SELECT *, max(ts_us) OVER (PARTITION BY id, sample_num) AS hi FROM px) GROUP BY id, sample_num)""",
)
def _(spark, folder):
    log = adapters.events_log(spark, folder)
    out = snapshots.realistic_snapshots(log, [], success_event="purchase", horizon_seconds=H12)
    return r6(
        out.select(
            "id", "sample_num", *[f"events_last_{w}d" for w in (1, 3, 7, 14, 30)], *[f"recent_{w}d_to_30d" for w in (1, 3, 7)]
        )
    )


@query(
    "top_events",
    with_(OL_LABEL)
    + """SELECT event_name, count(*) AS n FROM ol JOIN lb USING (id) WHERE journey_status IN ('successful', 'incomplete')
  AND event_name <> 'order_shipped' GROUP BY event_name ORDER BY n DESC, event_name LIMIT 50""",
)
def _(spark, folder):
    log, labeled = ol(spark, folder)
    return snapshots.top_events(log.events, labeled)


@query(
    "event_count_pivot",
    clean_sql("ev", EV_LABEL, "purchase")
    + "SELECT id, sample_num, "
    + ", ".join(f"count(*) FILTER (event_name = '{n}') AS cnt_{n}" for n in EV_NAMES)
    + " FROM px GROUP BY id, sample_num",
)
def _(spark, folder):
    log, labeled = ev(spark, folder)
    names = snapshots.vocabulary(snapshots.top_events(log.events, labeled, success_event="purchase"), "event_name")
    out = snapshots.realistic_snapshots(log, names, success_event="purchase", horizon_seconds=H12)
    return out.select("id", "sample_num", *[f"cnt_{n}" for n in sorted(names)])


OPEN_NB = """nb AS (SELECT *, row_number() OVER w AS pos, lag(ts_us) OVER w AS prev_us FROM ev WHERE event_name IS DISTINCT FROM 'purchase'
  WINDOW w AS (PARTITION BY id ORDER BY ts_us, ed_id))"""


@query(
    "open_features",
    with_(EV, OPEN_NB)
    + "SELECT f.*, x.* EXCLUDE (id) FROM ("
    + feature_sql("nb", "id, id || '::open' AS snapshot_id", "lo", "id")
    + f""") f JOIN (SELECT id, {TRAIL}, {LASTK}, {", ".join(f"count(*) FILTER (event_name = '{n}') AS cnt_{n}" for n in EV_NAMES)}
FROM (SELECT *, max(ts_us) OVER (PARTITION BY id) AS hi, max(pos) OVER (PARTITION BY id) AS top FROM nb) GROUP BY id) x ON x.id = f.id""",
)
def _(spark, folder):
    log = adapters.events_log(spark, folder)
    out = snapshots.open_snapshots(log, EV_NAMES, success_event="purchase")
    return r6(
        out.select(
            "id", "snapshot_id", *FEATURES, *[f"events_last_{w}d" for w in (1, 3, 7, 14, 30)],
            *[f"last{i}_event" for i in range(1, 6)], *[f"cnt_{n}" for n in EV_NAMES],
        )
    )


@query(
    "open_tabular",
    with_(OL, numbered("ol"), "ct AS (SELECT id, ed_id, count(*) AS c, sum(count(*)) OVER (PARTITION BY id) AS k FROM ol GROUP BY id, ed_id)")
    + f"""SELECT p.*, 1.0::DOUBLE AS snapshot_frac_of_journey,
  round(CASE WHEN snapshot_num_actions > 1 THEN prefix_duration_seconds / (snapshot_num_actions - 1) ELSE 0 END, 6) AS avg_gap_seconds,
  x.* EXCLUDE (id)
FROM ({PREFIX.format(key="id", src="nb")}) p JOIN (SELECT id, round(greatest(0.0, sum(-(c / k) * log2(c / k))), 6) AS action_entropy, max(c) AS max_action_repeat,
  {", ".join(f"coalesce(max(c) FILTER (ed_id = {a}), 0) AS action_count_{a}" for a in OL_ACTIONS)},
  {", ".join(f"round(coalesce(max(c / k) FILTER (ed_id = {a}), 0), 6) AS action_prop_{a}" for a in OL_ACTIONS)},
  {", ".join(f"max((ed_id = {e})::INT) AS {n}" for n, e in MILESTONES.items())} FROM ct GROUP BY id) x ON x.id = p.id""",
)
def _(spark, folder):
    return r6(snapshots.open_tabular(adapters.orders_log(spark, folder), OL_ACTIONS))


@query(
    "align_features",
    with_(OL) + "SELECT id, count(*) FILTER (ed_id = 4) AS action_count_4, 0 AS action_count_99, count(*) FILTER (ed_id = 28) AS action_count_28 FROM ol GROUP BY id",
)
def _(spark, folder):
    out = snapshots.open_tabular(adapters.orders_log(spark, folder), OL_ACTIONS)
    return encode.align_features(out, ["action_count_4", "action_count_99", "action_count_28"])


@query(
    "label_encode",
    with_(EV_LABEL, "d AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS k FROM (SELECT DISTINCT first_action::VARCHAR AS c FROM lb WHERE journey_status = 'successful'))")
    + "SELECT id, coalesce(k, -1)::INT AS last_action_code FROM lb LEFT JOIN d ON d.c = lb.last_action::VARCHAR",
)
def _(spark, folder):
    _log, labeled = ev(spark, folder)
    fitted = encode.fit_categories(labeled.where(F.col("journey_status") == "successful"), "first_action")
    return encode.label_encode(labeled, "last_action", fitted).select("id", "last_action_code")


@query(
    "one_hot",
    with_(EV_LABEL)
    + "SELECT id, "
    + ", ".join(f"coalesce((s = '{s}')::INT, 0) AS s_{s}" for s in ("incomplete", "successful"))
    + ", (s IS NULL)::INT AS s_nan FROM (SELECT id, CASE WHEN journey_status <> 'other' THEN journey_status END AS s FROM lb)",
)
def _(spark, folder):
    _log, labeled = ev(spark, folder)
    rows = labeled.select("id", F.when(F.col("journey_status") != "other", F.col("journey_status")).alias("s"))
    return encode.one_hot(rows, "s", encode.fit_categories(rows, "s")).drop("s")


SCALED = ["num_actions", "duration_seconds", "idle"]


@query(
    "impute_scale",
    with_(
        OL_LABEL,
        """x AS (SELECT id, num_actions::DOUBLE AS num_actions, duration_seconds::DOUBLE AS duration_seconds,
  CASE WHEN has_order_shipped THEN (end_us - completion_us) / 1e6 END AS idle FROM sm)""",
        "m AS (SELECT median(num_actions) AS a, median(duration_seconds) AS b, median(idle) AS c FROM x)",
        "y AS (SELECT id, coalesce(num_actions, a) AS num_actions, coalesce(duration_seconds, b) AS duration_seconds, coalesce(idle, c) AS idle FROM x, m)",
    )
    + "SELECT id, "
    + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) + 0.0 AS {c}" for c in SCALED)
    + " FROM y",
)
def _(spark, folder):
    log = adapters.orders_log(spark, folder)
    rows = assemble.journey_summary(log).select(
        "id", "num_actions", "duration_seconds",
        F.when(F.col("has_order_shipped"), (F.col("end_us") - F.col("completion_us")) / F.lit(1e6)).alias("idle"),
    )
    return r6(encode.fit_scaling(rows, SCALED).apply(rows))
