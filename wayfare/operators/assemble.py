"""Journeys: assembly, labels and summaries by outcome."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.constants import CUSTOMER_STATES, HORIZON_SECONDS, MILESTONES, SUCCESS_STATE
from wayfare.functions.columns import short_label, whole_seconds
from wayfare.functions.ordered import along, nth
from wayfare.functions.ranks import profile_values
from wayfare.sources.log import JourneyLog

# Events per array in one row of ``journey_parts``.
PART_ROWS = 10_000
RESOLVED = ("successful", "incomplete")


def journey_summary(log: JourneyLog, success_state: int = SUCCESS_STATE) -> DataFrame:
    """One row per journey from mergeable aggregates only, so length does not matter."""
    place = F.struct("ts_us", "ed_id", "event_name")
    shipped = F.col("ed_id") == success_state
    return log.events.groupBy("id").agg(
        F.count(F.lit(1)).alias("num_actions"),
        F.count_distinct("ed_id").alias("num_unique_actions"),
        F.min("event_timestamp").alias("start_time"),
        F.max("event_timestamp").alias("end_time"),
        F.min("ts_us").alias("start_us"),
        F.max("ts_us").alias("end_us"),
        whole_seconds(F.max("ts_us") - F.min("ts_us")).alias("duration_seconds"),
        F.min_by("ed_id", place).alias("first_action"),
        F.max_by("ed_id", place).alias("last_action"),
        F.bool_or(shipped).alias("has_order_shipped"),
        F.min(F.when(shipped, F.col("ts_us"))).alias("completion_us"),
    )


def journey_parts(log: JourneyLog, part_rows: int = PART_ROWS) -> DataFrame:
    """Ordered event arrays, at most ``part_rows`` events per row (most journeys are one part)."""
    rows = along(log.events, {"step": nth()})
    part = F.floor((F.col("step") - 1) / part_rows).cast("long").alias("part")
    item = F.struct("step", "event_timestamp", "event_name", "ed_id")
    grouped = rows.groupBy("id", part).agg(F.array_sort(F.collect_list(item)).alias("steps"))
    fields = lambda e: F.struct(e["event_timestamp"].alias("event_timestamp"), e["event_name"].alias("event_name"), e["ed_id"].alias("ed_id"))
    return grouped.select("id", "part", F.transform("steps", fields).alias("journey"))


def journey_events(
    parts: DataFrame, *, states: Iterable[int] | None = None, success_state: int | None = SUCCESS_STATE
) -> DataFrame:
    """Arrays back to events, optionally customer actions only (with or without success)."""
    rows = parts.select("id", F.inline("journey"))
    if states is None:
        return rows
    wanted = sorted({int(s) for s in states} | ({success_state} if success_state is not None else set()))
    return rows.where(F.col("ed_id").isin(wanted))


def completion_time(log: JourneyLog, success_state: int = SUCCESS_STATE) -> DataFrame:
    """Time of the first success event, null without one."""
    hit = F.when(F.col("ed_id") == success_state, F.col("ts_us"))
    return log.events.groupBy("id").agg(F.min(hit).alias("completion_us"))


def label_by_last_action(
    summary: DataFrame,
    end_us: Column,
    *,
    success_state: int = SUCCESS_STATE,
    horizon_seconds: float = HORIZON_SECONDS,
) -> DataFrame:
    """successful (last action is success), incomplete (idle for the horizon), other."""
    done = F.col("last_action") == success_state
    idle = end_us - F.col("end_us") >= F.lit(int(horizon_seconds * 1_000_000))
    return summary.withColumns(
        {
            "is_successful": done,
            "inactive": idle,
            "journey_status": F.when(done, "successful").when(idle, "incomplete").otherwise("other"),
        }
    )


def label_by_any_success(
    summary: DataFrame, end_us: Column, *, horizon_seconds: float = HORIZON_SECONDS
) -> DataFrame:
    """complete (any success), incomplete (none, idle beyond the horizon), ongoing."""
    idle = end_us - F.col("end_us") > F.lit(int(horizon_seconds * 1_000_000))
    group = F.when(F.col("has_order_shipped"), "complete").when(idle, "incomplete").otherwise("ongoing")
    return summary.withColumn("source_table", group)


def labeled_journeys(
    log: JourneyLog, *, success_state: int = SUCCESS_STATE, horizon_seconds: float = HORIZON_SECONDS
) -> DataFrame:
    summary = journey_summary(log, success_state)
    return label_by_last_action(summary, log.end(), success_state=success_state, horizon_seconds=horizon_seconds)


def resolved(labeled: DataFrame) -> DataFrame:
    return labeled.where(F.col("journey_status").isin(*RESOLVED))


def binary_labels(labeled: DataFrame) -> DataFrame:
    label = (F.col("journey_status") == "successful").cast("byte").alias("label")
    return resolved(labeled).select("id", label, "journey_status")


def tag_and_union(groups: Mapping[str, DataFrame], column: str = "source_table") -> DataFrame:
    """Stack tables, remembering where each row came from."""
    out: DataFrame | None = None
    for name, df in groups.items():
        tagged = df.withColumn(column, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def split_by_tag(df: DataFrame, names: Iterable[str], column: str = "source_table") -> dict[str, DataFrame]:
    return {name: df.where(F.col(column) == name).drop(column) for name in names}


def status_counts(labeled: DataFrame, status: str = "journey_status") -> DataFrame:
    return labeled.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def status_summary(labeled: DataFrame, status: str = "journey_status") -> DataFrame:
    """Action, unique-action and duration statistics by outcome, in one pass over the values."""
    measures = ["num_actions", "num_unique_actions", "duration_seconds"]
    long = labeled.select(
        status,
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])
        ).alias("m"),
    ).select(status, "m.measure", "m.value")
    stats = profile_values(long, "value", {"median": 0.5}, by=(status, "measure"))

    def pick(measure: str, column: str) -> Column:
        return F.max(F.when(F.col("measure") == measure, F.col(column)))

    return stats.groupBy(status).agg(
        pick("num_actions", "n").alias("n"),
        pick("num_actions", "mean").alias("mean_actions"),
        pick("num_actions", "median").alias("median_actions"),
        pick("num_actions", "std").alias("std_actions"),
        pick("num_unique_actions", "mean").alias("mean_unique"),
        pick("num_unique_actions", "median").alias("median_unique"),
        pick("duration_seconds", "mean").alias("mean_duration"),
        pick("duration_seconds", "median").alias("median_duration"),
        pick("duration_seconds", "max").alias("max_duration"),
    )


def top_actions_by_status(labeled: DataFrame, action: str, *, k: int = 10, status: str = "journey_status") -> DataFrame:
    """Most frequent first or last actions per outcome (counts are bounded by the vocabulary)."""
    counts = labeled.groupBy(status, action).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(status).orderBy(F.desc("n"), action))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def label_balance(df: DataFrame, *by: str, label: str = "label") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("mean_label"))


def current_state(log: JourneyLog, *, states: Iterable[int] = CUSTOMER_STATES, success_state: int = SUCCESS_STATE) -> DataFrame:
    """Last customer state, first and last time, count and observed age per journey."""
    place = F.struct("ts_us", "ed_id", "event_name")
    return (
        log.states(states, also=success_state)
        .events.groupBy("id")
        .agg(
            F.max_by("ed_id", place).alias("current_state"),
            F.min("ts_us").alias("first_us"),
            F.max("ts_us").alias("last_us"),
            F.count(F.lit(1)).alias("n_customer_actions"),
            ((F.max("ts_us") - F.min("ts_us")) / F.lit(1e6)).alias("observed_age_seconds"),
        )
    )


def open_journeys(
    log: JourneyLog,
    *,
    states: Iterable[int] = CUSTOMER_STATES,
    success_state: int = SUCCESS_STATE,
    horizon_seconds: float = HORIZON_SECONDS,
) -> DataFrame:
    """``current_state`` of the journeys still undecided, with status and state from one aggregation."""
    place = F.struct("ts_us", "ed_id", "event_name")
    kept = F.col("ed_id").isin(sorted({int(s) for s in states} | {success_state}))
    seen = F.when(kept, place)
    rows = log.events.groupBy("id").agg(
        F.max_by("ed_id", place).alias("_last"),
        F.max("ts_us").alias("_end"),
        F.max_by("ed_id", seen).alias("current_state"),
        F.min(F.when(kept, F.col("ts_us"))).alias("first_us"),
        F.max(F.when(kept, F.col("ts_us"))).alias("last_us"),
        F.count_if(kept).alias("n_customer_actions"),
    )
    idle = log.end() - F.col("_end") >= F.lit(int(horizon_seconds * 1_000_000))
    rows = rows.where((F.col("_last") != success_state) & ~idle & (F.col("n_customer_actions") > 0))
    age = ((F.col("last_us") - F.col("first_us")) / F.lit(1e6)).alias("observed_age_seconds")
    return rows.select("id", "current_state", "first_us", "last_us", "n_customer_actions", age)


def milestone_flags(log: JourneyLog, milestones: Mapping[str, int] = MILESTONES) -> DataFrame:
    """0/1 per milestone reached."""
    return log.events.groupBy("id").agg(
        *[F.max((F.col("ed_id") == ed).cast("byte")).alias(name) for name, ed in milestones.items()]
    )


def with_event_label(df: DataFrame, definitions: DataFrame, state: str = "state") -> DataFrame:
    """Attach event_name (the id itself when undefined) and a shortened label.

    The definitions are a dimension file; the planner broadcasts it while it is small.
    """
    names = definitions.select(F.col("event_definition_id").cast("long").alias(state), F.col("event_name").alias("_name"))
    out = df.join(names, state, "left")
    return out.withColumns(
        {
            "event_name": F.coalesce("_name", F.col(state).cast("string")),
            "event_label": short_label(F.col(state), F.col("_name")),
        }
    ).drop("_name")
