"""Registered queries: sources, cleaning, profiling, assembly and labels."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wayfare.constants import CUSTOMER_STATES
from wayfare.operators import assemble, clean
from wayfare.plans.registry import query, r6
from wayfare.plans.sql import CUSTOMER, CUSTOMER28, EV, EV_LABEL, OL, OL_LABEL, OL_RAW, uniform, with_
from wayfare.session import shared_folder
from wayfare.sources import adapters, readers, writers

H12 = 43_200


def definitions(spark, folder):
    """Event definitions derived from the log itself."""
    return (
        adapters.raw_events(spark, folder)
        .groupBy(F.col("ed_id").alias("event_definition_id"))
        .agg(F.min("event_name").alias("event_name"))
    )


@query("csv_roundtrip", with_(OL_RAW) + "SELECT id, ts_us, event_name, ed_id FROM ol_raw")
def _(spark, folder):
    path = f"{shared_folder(spark)}/csv/{uuid.uuid4().hex}"
    text = F.date_format("event_timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("event_timestamp")
    writers.write_csv(adapters.raw_orders(spark, folder).select("id", text, "event_name", "ed_id"), path)
    back = readers.read_events_csv(spark, path, strict=True)
    return back.select("id", F.unix_micros("event_timestamp").alias("ts_us"), "event_name", "ed_id")


@query(
    "shard_union",
    with_(EV, OL)
    + """SELECT id, count(*) FILTER (event_name = 'view') AS cnt_view, count(*) FILTER (event_name = 'click') AS cnt_click,
       0 AS cnt_add_to_cart, 'events' AS source_table FROM ev GROUP BY id
UNION ALL SELECT id, 0, 0, count(*) FILTER (event_name = 'add_to_cart'), 'orders' FROM ol GROUP BY id""",
)
def _(spark, folder):
    def counts(log, names):
        return log.events.groupBy("id").agg(*[F.count_if(F.col("event_name") == n).alias(f"cnt_{n}") for n in names])

    parts = assemble.tag_and_union(
        {
            "events": counts(adapters.events_log(spark, folder), ["view", "click"]),
            "orders": counts(adapters.orders_log(spark, folder), ["add_to_cart"]),
        }
    )
    return writers.union_shards([parts])


@query(
    "state_dim_check",
    with_(EV)
    + f"""SELECT CAST(s AS BIGINT) AS state FROM unnest({CUSTOMER.replace("(", "[").replace(")", "]")}) AS u(s)
WHERE s NOT IN (SELECT ed_id FROM ev)""",
)
def _(spark, folder):
    return readers.unknown_states(definitions(spark, folder))


@query("id_template", with_(OL_RAW) + "SELECT DISTINCT id, 0.0::DOUBLE AS order_shipped FROM ol_raw")
def _(spark, folder):
    return readers.id_template(adapters.raw_orders(spark, folder))


@query("dedup_events", with_(OL) + "SELECT id, ts_us, event_name, ed_id FROM ol")
def _(spark, folder):
    log = adapters.orders_log(spark, folder)
    return log.events.select("id", "ts_us", "event_name", "ed_id")


@query(
    "dedup_by_id",
    with_(OL_RAW) + "SELECT id, ts_us, ed_id, min(event_name) AS event_name FROM ol_raw GROUP BY id, ts_us, ed_id",
)
def _(spark, folder):
    rows = clean.deduplicate(adapters.raw_orders(spark, folder), ("id", "ed_id", "event_timestamp"))
    return rows.select("id", F.unix_micros("event_timestamp").alias("ts_us"), "ed_id", "event_name")


@query(
    "duplicate_report",
    with_(OL_RAW)
    + """SELECT (SELECT count(*) FROM ol_raw) AS total_rows, count(*) AS unique_rows,
  (SELECT count(*) FROM ol_raw) - count(*) AS duplicate_rows,
  round(((SELECT count(*) FROM ol_raw) - count(*)) / (SELECT count(*) FROM ol_raw), 6) AS duplicate_share
FROM (SELECT DISTINCT id, event_name, ts_us FROM ol_raw)""",
)
def _(spark, folder):
    return r6(clean.duplicate_report(adapters.raw_orders(spark, folder)))


@query(
    "parse_ts",
    with_(EV) + "SELECT id, ts_us AS parsed_us, (ts_us // 1000000) * 1000000 AS strict_us FROM ev",
)
def _(spark, folder):
    rows = adapters.raw_events(spark, folder)
    iso = F.date_format("event_timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    fixed = F.date_format("event_timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return rows.select(
        "id",
        F.unix_micros(readers.parse_time(iso)).alias("parsed_us"),
        F.unix_micros(readers.parse_time(fixed, strict=True)).alias("strict_us"),
    )


@query(
    "renumber_steps",
    with_(OL)
    + "SELECT id, ts_us, ed_id, row_number() OVER (PARTITION BY id ORDER BY ts_us, ed_id) AS step FROM ol",
)
def _(spark, folder):
    return clean.renumber_steps(adapters.orders_log(spark, folder)).select("id", "ts_us", "ed_id", "step")


@query(
    "dataset_profile",
    with_(OL_RAW)
    + """SELECT count(*) AS n_events, count(DISTINCT id) AS n_journeys,
  min(ts_us) AS first_us, max(ts_us) AS last_us FROM ol_raw""",
)
def _(spark, folder):
    out = clean.dataset_profile(adapters.raw_orders(spark, folder))
    return out.select(
        "n_events", "n_journeys", F.unix_micros("first_event").alias("first_us"), F.unix_micros("last_event").alias("last_us")
    )


@query(
    "sample_journeys",
    with_(EV)
    + f"""SELECT id, ts_us, ed_id FROM ev WHERE id IN (
  SELECT id FROM (SELECT DISTINCT id FROM ev) ORDER BY {uniform(42, "id")}, id LIMIT 50)""",
)
def _(spark, folder):
    out = clean.sample_journeys(adapters.raw_events(spark, folder), 50)
    return out.select("id", F.unix_micros("event_timestamp").alias("ts_us"), "ed_id")


# Seconds of orders run to 2e8; their statistics are compared to the millisecond.
STATS = """count(*) AS n, round(avg({v}), 6) AS mean, round(stddev_samp({v}), 6) AS std,
  min({v})::DOUBLE AS min, max({v})::DOUBLE AS max, round(median({v})::DOUBLE, 6) AS median"""


@query(
    "journey_length_stats",
    with_(OL) + "SELECT " + STATS.format(v="length") + " FROM (SELECT id, count(*) AS length FROM ol GROUP BY id)",
)
def _(spark, folder):
    return r6(clean.length_stats(adapters.orders_log(spark, folder).events))


@query(
    "journey_duration_stats",
    with_(OL)
    + "SELECT "
    + STATS.format(v="d")
    + " FROM (SELECT id, (max(ts_us) - min(ts_us)) / 1e6 AS d FROM ol GROUP BY id)",
)
def _(spark, folder):
    return r6(clean.duration_stats(adapters.orders_log(spark, folder)))


@query(
    "event_frequency",
    with_(OL) + "SELECT event_name, count(*) AS n FROM ol GROUP BY event_name ORDER BY n DESC, event_name LIMIT 20",
)
def _(spark, folder):
    return clean.event_frequency(adapters.orders_log(spark, folder).events)


GAPS = """gaps AS (SELECT id, ts_us, ed_id, (ts_us - lag(ts_us) OVER (PARTITION BY id ORDER BY ts_us, ed_id)) / 1e6 AS gap FROM {log}),
g AS (SELECT * FROM gaps WHERE gap IS NOT NULL)"""


@query("interevent_gaps", with_(EV, GAPS.format(log="ev")) + "SELECT id, ts_us, ed_id, round(gap, 6) AS gap_seconds FROM g")
def _(spark, folder):
    out = clean.interevent_gaps(adapters.events_log(spark, folder))
    return r6(out.select("id", F.unix_micros("event_timestamp").alias("ts_us"), "ed_id", "gap_seconds"))


@query("interevent_gap_stats", with_(OL, GAPS.format(log="ol")) + "SELECT " + STATS.format(v="gap") + " FROM g")
def _(spark, folder):
    return r6(clean.gap_stats(adapters.orders_log(spark, folder)))


@query(
    "describe_lengths",
    with_(OL)
    + """SELECT count(*) AS n, 0::BIGINT AS null_count, round(avg(length), 6) AS mean, round(stddev_samp(length), 6) AS std,
  min(length)::DOUBLE AS min, max(length)::DOUBLE AS max, round(quantile_cont(length, 0.25), 6) AS p25,
  round(quantile_cont(length, 0.5), 6) AS p50, round(quantile_cont(length, 0.75), 6) AS p75
FROM (SELECT id, count(*) AS length FROM ol GROUP BY id)""",
)
def _(spark, folder):
    lengths = clean.journey_lengths(adapters.orders_log(spark, folder).events)
    return r6(clean.describe(lengths, "length"))


@query(
    "length_histogram",
    with_(EV)
    + """SELECT least(49, floor((length - lo) * 50 / (hi - lo)))::INTEGER AS bin, count(*) AS n
FROM (SELECT length, min(length) OVER () AS lo, max(length) OVER () AS hi
      FROM (SELECT id, count(*)::DOUBLE AS length FROM ev GROUP BY id)) GROUP BY 1""",
)
def _(spark, folder):
    lengths = clean.journey_lengths(adapters.events_log(spark, folder).events)
    return clean.histogram(lengths, "length")


@query(
    "boxplot_by_status",
    with_(OL_LABEL)
    + """SELECT journey_status, count(*) AS n, min(duration_seconds)::DOUBLE AS min,
  round(quantile_cont(duration_seconds, 0.25), 6) AS q1, round(quantile_cont(duration_seconds, 0.5), 6) AS median,
  round(quantile_cont(duration_seconds, 0.75), 6) AS q3, max(duration_seconds)::DOUBLE AS max
FROM lb GROUP BY journey_status""",
)
def _(spark, folder):
    labeled = assemble.labeled_journeys(adapters.orders_log(spark, folder))
    return r6(clean.five_numbers(labeled, "duration_seconds", "journey_status"))


@query(
    "flatten_journeys",
    with_(OL_LABEL)
    + """SELECT id, num_actions, num_unique_actions, start_us, end_us, duration_seconds, first_action, last_action, has_order_shipped FROM sm""",
)
def _(spark, folder):
    log = adapters.orders_log(spark, folder)
    return assemble.journey_summary(log).drop("start_time", "end_time", "completion_us")


@query(
    "journey_parts",
    with_(OL, "nb AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts_us, ed_id) AS pos FROM ol)")
    + """SELECT id, (pos - 1) // 8 AS part, count(*)::INT AS n, string_agg(ed_id::VARCHAR, '>' ORDER BY pos) AS actions,
  string_agg(event_name, '>' ORDER BY pos) AS names FROM nb GROUP BY ALL""",
)
def _(spark, folder):
    parts = assemble.journey_parts(adapters.orders_log(spark, folder), 8)
    return parts.select(
        "id",
        "part",
        F.size("journey").alias("n"),
        F.concat_ws(">", F.transform("journey", lambda e: e["ed_id"].cast("string"))).alias("actions"),
        F.concat_ws(">", F.transform("journey", lambda e: e["event_name"])).alias("names"),
    )


@query(
    "completion_time",
    with_(OL_LABEL) + "SELECT id, completion_us FROM sm",
)
def _(spark, folder):
    return assemble.completion_time(adapters.orders_log(spark, folder))


@query(
    "label_last_action",
    with_(OL_LABEL) + "SELECT id, last_action, end_us, is_successful, inactive, journey_status FROM lb",
)
def _(spark, folder):
    out = assemble.labeled_journeys(adapters.orders_log(spark, folder))
    return out.select("id", "last_action", "end_us", "is_successful", "inactive", "journey_status")


@query(
    "label_last_action_events",
    with_(EV_LABEL) + "SELECT id, last_action, end_us, is_successful, inactive, journey_status FROM lb",
)
def _(spark, folder):
    out = assemble.labeled_journeys(adapters.events_log(spark, folder), horizon_seconds=H12)
    return out.select("id", "last_action", "end_us", "is_successful", "inactive", "journey_status")


ANY = """CASE WHEN has_order_shipped THEN 'complete'
  WHEN (SELECT max(ts_us) FROM ol) - end_us > 5184000000000 THEN 'incomplete' ELSE 'ongoing' END"""


@query("label_any_success", with_(OL_LABEL) + f"SELECT id, completion_us, {ANY} AS source_table FROM sm")
def _(spark, folder):
    log = adapters.orders_log(spark, folder)
    out = assemble.label_by_any_success(assemble.journey_summary(log), log.end())
    return out.select("id", "completion_us", "source_table")


@query(
    "union_tagged",
    with_(OL_LABEL)
    + """SELECT id, num_actions, 'complete' AS source_table FROM lb WHERE journey_status = 'successful'
UNION ALL SELECT id, num_actions, 'incomplete' FROM lb WHERE journey_status = 'incomplete'""",
)
def _(spark, folder):
    labeled = assemble.labeled_journeys(adapters.orders_log(spark, folder)).select("id", "num_actions", "journey_status")
    groups = assemble.split_by_tag(labeled, ["successful", "incomplete"], "journey_status")
    return assemble.tag_and_union({"complete": groups["successful"], "incomplete": groups["incomplete"]})


@query("status_counts", with_(OL_LABEL) + "SELECT journey_status, count(*) AS n FROM lb GROUP BY journey_status")
def _(spark, folder):
    return assemble.status_counts(assemble.labeled_journeys(adapters.orders_log(spark, folder)))


@query(
    "status_summary",
    with_(OL_LABEL)
    + """SELECT journey_status, count(*) AS n, round(avg(num_actions), 6) AS mean_actions,
  round(median(num_actions)::DOUBLE, 6) AS median_actions, round(stddev_samp(num_actions), 6) AS std_actions,
  round(avg(num_unique_actions), 6) AS mean_unique, round(median(num_unique_actions)::DOUBLE, 6) AS median_unique,
  round(avg(duration_seconds), 6) AS mean_duration, round(median(duration_seconds)::DOUBLE, 6) AS median_duration,
  max(duration_seconds)::DOUBLE AS max_duration
FROM lb GROUP BY journey_status""",
)
def _(spark, folder):
    return r6(assemble.status_summary(assemble.labeled_journeys(adapters.orders_log(spark, folder))))


TOP = """SELECT journey_status, {a}, n, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY journey_status ORDER BY n DESC, {a}) AS rank FROM (
    SELECT journey_status, {a}, count(*) AS n FROM lb GROUP BY 1, 2)) WHERE rank <= 10"""


@query("first_action_top", with_(OL_LABEL) + TOP.format(a="first_action"))
def _(spark, folder):
    return assemble.top_actions_by_status(assemble.labeled_journeys(adapters.orders_log(spark, folder)), "first_action")


@query("dropoff_top", with_(OL_LABEL) + TOP.format(a="last_action"))
def _(spark, folder):
    return assemble.top_actions_by_status(assemble.labeled_journeys(adapters.orders_log(spark, folder)), "last_action")


@query(
    "binary_labels",
    with_(OL_LABEL)
    + """SELECT id, (journey_status = 'successful')::INTEGER AS label, journey_status
FROM lb WHERE journey_status IN ('successful', 'incomplete')""",
)
def _(spark, folder):
    out = assemble.binary_labels(assemble.labeled_journeys(adapters.orders_log(spark, folder)))
    return out.withColumn("label", F.col("label").cast("int"))


@query(
    "label_balance",
    with_(OL_LABEL)
    + """SELECT (journey_status = 'successful')::INTEGER AS label, journey_status, count(*) AS n,
  round(avg((journey_status = 'successful')::INTEGER), 6) AS mean_label
FROM lb WHERE journey_status IN ('successful', 'incomplete') GROUP BY 1, 2
UNION ALL SELECT NULL, 'all', count(*), round(avg((journey_status = 'successful')::INTEGER), 6)
FROM lb WHERE journey_status IN ('successful', 'incomplete')""",
)
def _(spark, folder):
    labels = assemble.binary_labels(assemble.labeled_journeys(adapters.orders_log(spark, folder)))
    labels = labels.withColumn("label", F.col("label").cast("int"))
    both = assemble.label_balance(labels, "label", "journey_status").unionByName(
        assemble.label_balance(labels).select(
            F.lit(None).cast("int").alias("label"), F.lit("all").alias("journey_status"), "n", "mean_label"
        )
    )
    return r6(both)


@query("journey_events", with_(EV) + f"SELECT id, ts_us, event_name, ed_id FROM ev WHERE ed_id IN {CUSTOMER28}")
def _(spark, folder):
    parts = assemble.journey_parts(adapters.events_log(spark, folder))
    rows = assemble.journey_events(parts, states=CUSTOMER_STATES)
    return rows.select("id", F.unix_micros("event_timestamp").alias("ts_us"), "event_name", "ed_id")


@query(
    "open_current_state",
    with_(EV)
    + f"""SELECT id, arg_max(ed_id, (ts_us, ed_id)) AS current_state, min(ts_us) AS first_us, max(ts_us) AS last_us,
  count(*) AS n_customer_actions, round((max(ts_us) - min(ts_us)) / 1e6, 6) AS observed_age_seconds
FROM ev WHERE ed_id IN {CUSTOMER28} GROUP BY id""",
)
def _(spark, folder):
    return r6(assemble.current_state(adapters.events_log(spark, folder)))


@query(
    "milestone_flags",
    with_(OL)
    + "SELECT id, "
    + ", ".join(
        f"bool_or(ed_id = {e})::INTEGER AS {n}"
        for n, e in {
            "has_add_to_cart": 11,
            "has_begin_checkout": 6,
            "has_application_submit": 3,
            "has_place_downpayment": 7,
            "has_place_order": 8,
            "has_account_activation": 29,
        }.items()
    )
    + " FROM ol GROUP BY id",
)
def _(spark, folder):
    out = assemble.milestone_flags(adapters.orders_log(spark, folder))
    return out.select("id", *[F.col(c).cast("int").alias(c) for c in out.columns if c != "id"])


@query(
    "event_labels",
    with_(EV, OL)
    + """SELECT o.state, coalesce(d.event_name, o.state::VARCHAR) AS event_name,
  CASE WHEN o.state = -1 THEN '60d inactivity' || chr(10) || 'failure' ELSE
    o.state::VARCHAR || chr(10) || CASE WHEN length(replace(coalesce(d.event_name, o.state::VARCHAR), '_', ' ')) > 22
      THEN left(replace(coalesce(d.event_name, o.state::VARCHAR), '_', ' '), 21) || '…'
      ELSE replace(coalesce(d.event_name, o.state::VARCHAR), '_', ' ') END END AS event_label, n
FROM (SELECT ed_id AS state, count(*) AS n FROM ol GROUP BY ed_id UNION ALL SELECT -1, 0) o
LEFT JOIN (SELECT ed_id AS state, min(event_name) AS event_name FROM ev GROUP BY ed_id) d USING (state)""",
)
def _(spark, folder):
    counts = (
        adapters.orders_log(spark, folder).events.groupBy(F.col("ed_id").alias("state")).agg(F.count(F.lit(1)).alias("n"))
    )
    failure = spark.range(1).select(F.lit(-1).cast("long").alias("state"), F.lit(0).cast("long").alias("n"))
    return assemble.with_event_label(counts.unionByName(failure), definitions(spark, folder))
