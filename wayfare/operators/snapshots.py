"""Leakage-safe prefix snapshots and their features.

A snapshot is a prefix of a journey, so all its features are running values at the
last event of the prefix.  They are computed once along each journey; taking a snapshot
then means picking an event by position or by time.  Samples of one journey share
that pass, prefixes are never copied.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.constants import (
    DAY_US,
    HORIZON_SECONDS,
    MAX_SAMPLES_PER_JOURNEY,
    MILESTONES,
    RECENT_WINDOWS_DAYS,
    SUCCESS_EVENT,
    SUCCESS_STATE,
    TOP_N_ACTIONS,
    TOP_N_EVENTS,
)
from wayfare.functions.columns import clean_text, days, sample_count, uniform, whole_seconds
from wayfare.functions.ordered import (
    ORDER,
    SLICE,
    along,
    latest,
    nth,
    previous,
    recent,
    running_max,
    running_sum,
    total_max,
    total_min,
    total_sum,
)
from wayfare.operators.assemble import PART_ROWS, RESOLVED, journey_parts
from wayfare.sources.log import JourneyLog

MISSING = "missing"
LAST_EVENTS = 5


# ---- where a prefix ends -------------------------------------------------


def fraction_cut(n: Column, fraction: float = 0.7) -> Column:
    """Events kept of a journey of ``n``: at least one, never the last of several."""
    k = F.greatest(F.lit(1), F.least(n - 1, F.floor(F.lit(fraction) * n)))
    return F.when(n <= 1, 1).otherwise(k).cast("long")


def random_cut(n: Column, *, seed: int = 42) -> Column:
    """Uniform over 1 .. n - 1 (1 for a single event), drawn from the journey id."""
    k = 1 + F.floor(uniform(seed, "id") * (n - 1))
    return F.when(n <= 1, 1).otherwise(F.least(n - 1, k)).cast("long")


def with_outcome(log: JourneyLog, *, success_state: int, horizon_seconds: float) -> JourneyLog:
    """Attach what the whole journey tells: start, end, first success, length and status.

    Totals over the groups the ordered steps use anyway, so labels need no second pass over the log.
    """
    rows = along(
        log.events,
        {
            "_j_last": total_max(F.struct(*ORDER)),
            "_j_start": total_min(F.col("ts_us")),
            "_j_done": total_min(F.when(F.col("ed_id") == success_state, F.col("ts_us"))),
            "_j_n": total_sum(F.lit(1)),
        },
    )
    idle = log.end() - F.col("_j_last.ts_us") >= F.lit(int(horizon_seconds * 1_000_000))
    status = F.when(F.col("_j_last.ed_id") == success_state, "successful").when(idle, "incomplete").otherwise("other")
    return log.with_events(rows.withColumn("journey_status", status))


def sample_points(
    *, seed: int, max_samples: int, realistic: bool, success_fraction: float = 0.70
) -> Column:
    """Random cutoff times of a journey as an array of (sample_num, cutoff_us); empty if it has none.

    Plain samples lie anywhere between first and last event.  Realistic samples end at the
    first success and, for successful journeys, at 70 % of the way there; journeys without any span are skipped.
    """
    success = F.col("journey_status") == "successful"
    end = F.coalesce("_j_done", "_j_last.ts_us") if realistic else F.col("_j_last.ts_us")
    span = end - F.col("_j_start")
    reach = span.cast("double")
    if realistic:
        reach = F.when(success, span * F.lit(success_fraction)).otherwise(reach)

    def point(k: Column) -> Column:
        cutoff = F.col("_j_start") + F.floor(uniform(seed, "id", k) * reach).cast("long")
        return F.struct(k.alias("sample_num"), cutoff.alias("cutoff_us"))

    points = F.transform(F.sequence(F.lit(1), sample_count(span, max_samples)), point)
    usable = F.col("journey_status").isin(*RESOLVED)
    return F.when(usable & (span > 0) if realistic else usable, points)


# ---- running features ----------------------------------------------------


def prefix_rows(
    log: JourneyLog,
    *,
    actions: Sequence[int] = (),
    names: Sequence[str] = (),
    milestones: Mapping[str, int] | None = None,
    windows: Sequence[int] = (),
) -> DataFrame:
    """Every event with the running features of the prefix that ends at it.

    ``actions`` and ``names`` ask for running counts per event id or name (short lists);
    ``windows`` for trailing counts in days (only for logs without hot journeys, see
    ``trailing_counts``).
    """
    rows = log.events.withColumn("event_name", F.coalesce("event_name", F.col("ed_id").cast("string")))
    rows = along(rows, {"_id_occ": nth()}, key=("id", "ed_id"))
    rows = along(rows, {"_name_occ": nth()}, key=("id", "event_name"))
    occ = F.col("_id_occ").cast("double")
    # c log2 c - (c-1) log2 (c-1): what one more occurrence adds to sum(c log2 c).
    grown = occ * F.log2(occ) - F.when(occ > 1, (occ - 1) * F.log2(occ - 1)).otherwise(0.0)
    steps = {
        "seq": nth(),
        "n": total_sum(F.lit(1)),
        "_first": total_min(F.struct(*ORDER)),
        "_last": total_max(F.struct(*ORDER)),
        "_prev_us": previous(F.col("ts_us")),
        "last_names": recent(F.col("event_name"), LAST_EVENTS),
        "unique_ids": running_sum((F.col("_id_occ") == 1).cast("long")),
        "unique_names": running_sum((F.col("_name_occ") == 1).cast("long")),
        "_clogc": running_sum(grown),
        "max_repeat": running_max(F.col("_id_occ")),
    }
    steps |= {f"id_{a}": running_sum((F.col("ed_id") == a).cast("long")) for a in actions}
    steps |= {f"name_{i}": running_sum((F.col("event_name") == n).cast("long")) for i, n in enumerate(names)}
    steps |= {
        flag: running_max((F.col("ed_id") == ed).cast("int")) for flag, ed in (milestones or {}).items()
    }
    rows = along(rows, steps)
    gap = F.col("ts_us") - F.col("_prev_us")
    exact = gap.cast("decimal(19,0)")
    rows = along(
        rows,
        {
            "_gap_sum": running_sum(gap),
            # Whole numbers: close gaps of a long journey keep their spread.
            "_gap_square": running_sum(exact * exact),
            "_gap_max": running_max(gap.cast("double")),
        },
    )
    if windows:
        if SLICE in rows.columns:
            raise ValueError("trailing windows on a sliced log go through trailing_counts")
        rows = rows.withColumns({f"events_last_{w}d": _trailing(w) for w in windows})
    n = F.col("seq").cast("double")
    return rows.withColumn("entropy", F.greatest(F.lit(0.0), F.log2(n) - F.col("_clogc") / n))


def _trailing(window_days: int) -> Column:
    frame = Window.partitionBy("id").orderBy("ts_us").rangeBetween(-window_days * DAY_US, Window.currentRow)
    return F.count(F.lit(1)).over(frame)


def action_columns(
    *,
    actions: Sequence[int] = (),
    milestones: Mapping[str, int] | None = None,
    full: Column | None = None,
) -> list[Column]:
    """Snapshot columns over ``prefix_rows``: counts, times, entropy, repeats, milestones, proportions."""
    k = F.col("seq")
    span = F.col("ts_us") - F.col("_first.ts_us")
    duration = whole_seconds(span)
    total = full if full is not None else F.col("n")
    out = [
        total.alias("full_num_actions"),
        k.alias("snapshot_num_actions"),
        (k / total).alias("snapshot_frac_of_journey"),
        F.col("_first.ed_id").alias("first_action_so_far"),
        F.col("ed_id").alias("current_last_action"),
        F.col("unique_ids").alias("num_unique_actions_so_far"),
        duration.alias("prefix_duration_seconds"),
        F.when(k > 1, duration / (k - 1)).otherwise(0.0).alias("avg_gap_seconds"),
        F.when(k > 1, whole_seconds(F.col("ts_us") - F.col("_prev_us"))).otherwise(0).cast("long").alias(
            "time_since_prev_action_seconds"
        ),
        F.col("entropy").alias("action_entropy"),
        F.col("max_repeat").alias("max_action_repeat"),
    ]
    out += [F.col(f"id_{a}").alias(f"action_count_{a}") for a in actions]
    out += [F.col(flag) for flag in (milestones or {})]
    out += [F.coalesce(F.try_divide(F.col(f"id_{a}"), k), F.lit(0.0)).alias(f"action_prop_{a}") for a in actions]
    return out


def event_columns(names: Sequence[str], start_us: Column, windows: Sequence[int] = RECENT_WINDOWS_DAYS) -> list[Column]:
    """Realistic snapshot columns over ``prefix_rows`` of a log without success events."""
    k = F.col("seq")
    age = days(F.col("ts_us") - start_us)
    span = days(F.col("ts_us") - F.col("_first.ts_us"))
    gaps = (k - 1).cast("double")
    mean = F.col("_gap_sum") / gaps
    # n x sum of squares - square of the sum, exact below 38 digits.
    whole, count = F.col("_gap_sum").cast("decimal(19,0)"), (k - 1).cast("decimal(18,0)")
    apart = F.try_subtract(F.try_multiply(F.col("_gap_square"), count), F.try_multiply(whole, whole)).cast("double") / (gaps * gaps)
    spread = F.greatest(F.lit(0.0), F.coalesce(apart, F.col("_gap_square").cast("double") / gaps - mean * mean))
    out = [
        F.col("ts_us").alias("snapshot_us"),
        age.alias("snapshot_age_days"),
        k.alias("num_events"),
        F.col("unique_names").alias("num_unique_event_names"),
        F.col("unique_ids").alias("num_unique_ed_ids"),
        F.col("_first.ts_us").alias("first_event_us"),
        F.col("ts_us").alias("last_event_us"),
        F.col("_first.event_name").alias("first_event_name"),
        F.col("event_name").alias("last_event_name"),
        F.col("_first.ed_id").alias("first_ed_id"),
        F.col("ed_id").alias("last_ed_id"),
        F.col("ed_id").alias("current_state"),
        span.alias("active_span_days"),
        F.lit(0.0).alias("days_since_last_event"),
        (k / (age + 1)).alias("events_per_day_since_start"),
        (k / (span + 1)).alias("events_per_active_day"),
        F.when(k > 1, days(mean)).otherwise(0.0).alias("avg_gap_days"),
        F.when(k > 1, days(F.col("_gap_max"))).otherwise(0.0).alias("max_gap_days"),
        F.when(k > 2, days(F.sqrt(spread))).otherwise(0.0).alias("std_gap_days"),
    ]
    for i in range(1, LAST_EVENTS + 1):
        out.append(F.coalesce(F.try_element_at("last_names", F.lit(-i)), F.lit(MISSING)).alias(f"last{i}_event"))
    out += [F.col(f"events_last_{w}d") for w in windows]
    out += [F.col(f"name_{i}").alias(f"cnt_{clean_text(n)}") for i, n in enumerate(names)]
    return out


def recent_ratios(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {f"recent_{w}d_to_30d": F.col(f"events_last_{w}d") / (F.col("events_last_30d") + 1) for w in (1, 3, 7)}
    )


# ---- taking snapshots ----------------------------------------------------


def at_position(rows: DataFrame, cut: Column) -> DataFrame:
    """The prefix of ``cut`` events (an expression over ``n`` and ``id``) of every journey."""
    return rows.where(F.col("seq") == cut)


def at_samples(log: JourneyLog, rows: DataFrame, points: Column) -> DataFrame:
    """For each sample of a journey the running features of its last event at or before the cutoff.

    Samples enter the event order next to the first event of their journey and look back; nothing is
    joined and the log is read once.  Samples before the first event vanish.
    """
    features = [c for c in rows.columns if c not in ("id", SLICE)]
    kind = "struct<sample_num:int,cutoff_us:bigint>"
    event = F.array(F.lit(None).cast(kind))
    both = F.when((F.col("seq") == 1) & points.isNotNull(), F.concat(event, points.cast(f"array<{kind}>"))).otherwise(event)
    merged = rows.withColumn("_s", F.explode(both))
    merged = merged.withColumns(
        {
            "_probe": F.col("_s").isNotNull(),
            "_at": F.coalesce("_s.cutoff_us", "ts_us"),
            "_pos": F.coalesce(F.col("_s.sample_num").cast("long"), "seq"),
        }
    )
    merged = log.place(merged, "_at")
    found = along(
        merged, {"_found": latest(F.when(~F.col("_probe"), F.struct(*features)))}, order=("_at", "_probe", "_pos")
    )
    return found.where(F.col("_probe") & F.col("_found").isNotNull()).select("id", "_s.*", "_found.*")


def trailing_counts(
    log: JourneyLog, snapshots: DataFrame, windows: Sequence[int], *, keep: Sequence[str] = ("sample_num",)
) -> DataFrame:
    """events_last_{w}d for snapshots (id, *keep, snapshot_us, num_events) of logs with hot journeys.

    The count inside the window is the prefix length minus the events before the window, so
    each window is one more time probe instead of a frame over a huge journey.
    """
    from wayfare.operators.transitions import state_at

    probes = snapshots.select(
        "id", *keep, "snapshot_us", "num_events", F.explode(F.array(*[F.lit(w) for w in windows])).alias("_w")
    ).withColumn("probe_us", F.col("snapshot_us") - F.col("_w") * F.lit(DAY_US) - 1)
    before = state_at(log, probes, keep=(*keep, "_w")).select("id", *keep, "_w", F.col("seq").alias("_before"))
    counted = probes.join(before, ["id", *keep, "_w"], "left").withColumn(
        "_count", F.col("num_events") - F.coalesce("_before", F.lit(0))
    )
    wide = counted.groupBy("id", *keep).agg(
        *[F.max(F.when(F.col("_w") == w, F.col("_count"))).alias(f"events_last_{w}d") for w in windows]
    )
    return snapshots.drop(*[f"events_last_{w}d" for w in windows]).join(wide, ["id", *keep])


def position_snapshots(
    log: JourneyLog,
    cut: Column,
    *,
    actions: Sequence[int] = (),
    milestones: Mapping[str, int] = MILESTONES,
    success_state: int = SUCCESS_STATE,
    horizon_seconds: float = HORIZON_SECONDS,
) -> DataFrame:
    """One snapshot per resolved journey with action features and the remaining time to success.

    Outcome, length and end of the journey ride along with the running values; no join.
    """
    full = with_outcome(log, success_state=success_state, horizon_seconds=horizon_seconds)
    resolved = full.where(F.col("journey_status").isin(*RESOLVED))
    taken = at_position(prefix_rows(resolved, actions=actions, milestones=milestones), cut)
    success = F.col("journey_status") == "successful"
    remaining = (F.col("_last.ts_us") - F.col("ts_us")) / F.lit(1e6)
    return taken.select(
        "id",
        success.cast("int").alias("label"),
        F.col("journey_status").alias("final_outcome"),
        F.col("ts_us").alias("snapshot_us"),
        F.when(success, remaining).alias("remaining_seconds"),
        *action_columns(actions=actions, milestones=milestones),
    )


def time_snapshots(
    log: JourneyLog,
    *,
    seed: int = 42,
    max_samples: int = MAX_SAMPLES_PER_JOURNEY,
    actions: Sequence[int] = (),
    milestones: Mapping[str, int] = MILESTONES,
    success_state: int = SUCCESS_STATE,
    horizon_seconds: float = HORIZON_SECONDS,
) -> DataFrame:
    """Several random time prefixes per resolved journey with action features."""
    full = with_outcome(log, success_state=success_state, horizon_seconds=horizon_seconds)
    full = full.where(F.col("journey_status").isin(*RESOLVED))
    rows = prefix_rows(full, actions=actions, milestones=milestones)
    found = at_samples(log, rows, sample_points(seed=seed, max_samples=max_samples, realistic=False))
    return found.select(
        "id",
        "sample_num",
        "cutoff_us",
        (F.col("journey_status") == "successful").cast("int").alias("label"),
        "journey_status",
        *action_columns(actions=actions, milestones=milestones, full=F.col("_j_n")),
    )


def unsuccessful(success_event: str) -> Column:
    """Any event but success; one without a name is kept."""
    return ~F.col("event_name").eqNullSafe(F.lit(success_event))


def realistic_snapshots(
    log: JourneyLog,
    names: Sequence[str],
    *,
    seed: int = 42,
    max_samples: int = MAX_SAMPLES_PER_JOURNEY,
    success_event: str = SUCCESS_EVENT,
    success_state: int = SUCCESS_STATE,
    horizon_seconds: float = HORIZON_SECONDS,
    windows: Sequence[int] = RECENT_WINDOWS_DAYS,
) -> DataFrame:
    """Leakage-safe snapshots: no success event inside, successful journeys cut by 70 % of the way."""
    full = with_outcome(log, success_state=success_state, horizon_seconds=horizon_seconds)
    clean = full.where(F.col("journey_status").isin(*RESOLVED) & unsuccessful(success_event))
    direct = clean.hot is None
    rows = prefix_rows(clean, names=names, windows=windows if direct else ())
    found = at_samples(log, rows, sample_points(seed=seed, max_samples=max_samples, realistic=True))
    label = F.col("journey_status") == "successful"
    out = found.select(
        "id",
        "sample_num",
        F.concat_ws("::", "id", F.col("sample_num").cast("string")).alias("snapshot_id"),
        "journey_status",
        F.when(label, "complete").otherwise("incomplete").alias("source_table"),
        label.cast("int").alias("label"),
        "cutoff_us",
        *event_columns(names, F.col("_j_start"), windows if direct else ()),
    )
    if not direct:
        out = trailing_counts(log.where(unsuccessful(success_event)), out, windows)
    return recent_ratios(out)


def open_snapshots(
    log: JourneyLog,
    names: Sequence[str],
    *,
    success_event: str = SUCCESS_EVENT,
    windows: Sequence[int] = RECENT_WINDOWS_DAYS,
) -> DataFrame:
    """The realistic features on the whole observed prefix of every journey."""
    clean = log.where(unsuccessful(success_event))
    direct = clean.hot is None
    rows = prefix_rows(clean, names=names, windows=windows if direct else ())
    out = at_position(rows, F.col("n")).select(
        "id",
        F.lit(1).alias("sample_num"),
        F.concat("id", F.lit("::open")).alias("snapshot_id"),
        F.lit("open").alias("journey_status"),
        F.lit("open").alias("source_table"),
        *event_columns(names, F.col("_first.ts_us"), windows if direct else ()),
    )
    if not direct:
        out = trailing_counts(clean, out, windows)
    return recent_ratios(out)


def open_tabular(log: JourneyLog, actions: Sequence[int], milestones: Mapping[str, int] = MILESTONES) -> DataFrame:
    """Action features of every journey on all it shows so far."""
    rows = at_position(prefix_rows(log, actions=actions, milestones=milestones), F.col("n"))
    return rows.select("id", *action_columns(actions=actions, milestones=milestones))


# ---- vocabularies and arrays ---------------------------------------------


def top_events(
    events: DataFrame, labeled: DataFrame, *, n: int = TOP_N_EVENTS, success_event: str = SUCCESS_EVENT
) -> DataFrame:
    """Most frequent event names of resolved journeys, success left out; ties by name."""
    done = labeled.where(F.col("journey_status").isin(*RESOLVED)).select("id")
    rows = events.where(F.col("event_name").isNotNull() & (F.col("event_name") != success_event))
    # Counting per journey first keeps the join at one row per (id, name).
    counts = rows.groupBy("id", "event_name").agg(F.count(F.lit(1)).alias("n")).join(done, "id", "left_semi")
    return counts.groupBy("event_name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "event_name").limit(n)


def top_actions(rows: DataFrame, column: str = "ed_id", n: int = TOP_N_ACTIONS) -> DataFrame:
    """Most frequent ids; ties by id."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(n)


def vocabulary(top: DataFrame, column: str) -> list:
    """A top list as Python values, for a fixed set of count columns (bounded by its limit)."""
    return [r[0] for r in top.select(column).collect()]


def prefix_action_parts(
    log: JourneyLog, snapshots: DataFrame, length: str = "snapshot_num_actions", *, part_rows: int = PART_ROWS
) -> DataFrame:
    """Prefix action arrays of snapshots (one row per part of at most ``part_rows`` events)."""
    parts = journey_parts(log, part_rows).select("id", "part", F.col("journey.ed_id").alias("_ids"))
    left = F.col(length) - F.col("part") * part_rows
    keys = [c for c in snapshots.columns if c in ("id", "sample_num", "snapshot_id")]
    taken = F.slice("_ids", F.lit(1), F.least(F.lit(part_rows), left).cast("int"))
    return (
        snapshots.select(*keys, length)
        .join(parts, "id")
        .where(left > 0)
        .select(*keys, length, "part", taken.alias("prefix_actions"))
    )
