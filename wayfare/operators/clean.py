"""Cleaning and profiling of event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.functions.columns import uniform
from wayfare.functions.ordered import along, nth, previous
from wayfare.functions.ranks import profile_values
from wayfare.session import settle
from wayfare.sources.log import JourneyLog

# Bits of the hash that journeys are drawn by, of a range of it that is counted at a time, and ids put in order at most (unless their hashes are equal).
HASH_BITS, RANGE_BITS, ORDERED_IDS = 32, 10, 1_000
QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def deduplicate(events: DataFrame, key: tuple[str, ...] = ("id", "event_name", "event_timestamp")) -> DataFrame:
    """One row per key.  The survivor is the smallest remainder, whatever the partitioning."""
    rest = [c for c in events.columns if c not in key]
    if not rest:
        return events.distinct()
    kept = events.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_rest"))
    return kept.select(*key, "_rest.*").select(*events.columns)


def duplicate_report(
    events: DataFrame, key: tuple[str, ...] = ("id", "event_name", "event_timestamp")
) -> DataFrame:
    groups = events.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    total, unique = F.sum("n"), F.count(F.lit(1))
    return groups.agg(
        total.alias("total_rows"),
        unique.alias("unique_rows"),
        (total - unique).alias("duplicate_rows"),
        ((total - unique) / total).alias("duplicate_share"),
    )


def renumber_steps(log: JourneyLog) -> DataFrame:
    """Position 1..n of every event in its journey."""
    return along(log.events, {"step": nth()})


def dataset_profile(events: DataFrame) -> DataFrame:
    per_id = events.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_timestamp").alias("lo"), F.max("event_timestamp").alias("hi")
    )
    return per_id.agg(
        F.sum("n").alias("n_events"),
        F.count(F.lit(1)).alias("n_journeys"),
        F.min("lo").alias("first_event"),
        F.max("hi").alias("last_event"),
    )


def sample_journeys(events: DataFrame, n: int, *, seed: int = 42) -> DataFrame:
    """All events of ``n`` journeys drawn by hash (a sampling operator: the limit is the feature).

    The hash up to which ids are drawn is searched by counts of hash ranges, so tasks hold ranges and not the drawn ids; only the
    last few ids, where the search ends, are put in order.
    """
    hashed = (uniform(seed, "id") * F.lit(float(1 << HASH_BITS))).cast("long")
    ids = settle(events.select("id").distinct().withColumn("_h", hashed))
    low, bits, need = 0, HASH_BITS, n
    while True:
        step = max(0, bits - RANGE_BITS)
        inside = ids.where((F.col("_h") >= low) & (F.col("_h") < low + (1 << bits)))
        place = F.shiftright(F.col("_h") - low, step).alias("place")
        found = sorted(inside.groupBy(place).agg(F.count(F.lit(1)).alias("n")).collect())
        for r in found:
            if r["n"] >= need:
                low, bits, size = low + (r["place"] << step), step, r["n"]
                break
            need -= r["n"]
        else:
            return events.join(ids, "id", "left_semi")
        if size <= ORDERED_IDS or bits == 0:
            break
    last = ids.where((F.col("_h") >= low) & (F.col("_h") < low + (1 << bits))).orderBy("_h", "id").limit(need)
    return events.join(ids.where(F.col("_h") < low).unionByName(last), "id", "left_semi")


def journey_lengths(events: DataFrame) -> DataFrame:
    return events.groupBy("id").agg(F.count(F.lit(1)).alias("length"))


def journey_durations(log: JourneyLog) -> DataFrame:
    return log.events.groupBy("id").agg(((F.max("ts_us") - F.min("ts_us")) / 1e6).alias("duration_seconds"))


def length_stats(events: DataFrame) -> DataFrame:
    return profile_values(journey_lengths(events), "length", {"median": 0.5})


def duration_stats(log: JourneyLog) -> DataFrame:
    return profile_values(journey_durations(log), "duration_seconds", {"median": 0.5})


def event_frequency(events: DataFrame, k: int = 20) -> DataFrame:
    """Most frequent event names; ties go to the smaller name."""
    counts = events.groupBy("event_name").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "event_name").limit(k)


def interevent_gaps(log: JourneyLog) -> DataFrame:
    """Gap to the event before, in seconds; the first event of a journey has none."""
    rows = along(log.events, {"prev_us": previous(F.col("ts_us"))})
    gap = (F.col("ts_us") - F.col("prev_us")) / F.lit(1e6)
    return rows.where(F.col("prev_us").isNotNull()).select("id", "event_timestamp", "ed_id", gap.alias("gap_seconds"))


def gap_stats(log: JourneyLog) -> DataFrame:
    return profile_values(interevent_gaps(log), "gap_seconds", {"median": 0.5})


def describe(df: DataFrame, value: str, *, by: tuple[str, ...] = ()) -> DataFrame:
    """count, null_count, mean, std, min, quartiles, max."""
    stats = profile_values(df, value, QUARTILES, by=by)
    if by:
        nulls = df.groupBy(*by).agg(F.count_if(F.col(value).isNull()).alias("null_count"))
        return nulls.join(stats, list(by), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    missing = df.select(F.count_if(F.col(value).isNull())).scalar()
    return stats.select("n", missing.alias("null_count"), "mean", "std", "min", *QUARTILES, "max")


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Counts in equal-width bins between the smallest and the largest value; the last bin is closed."""
    ends = df.select(F.struct(F.min(value).alias("low"), F.max(value).alias("high"))).scalar()
    low, high = ends["low"], ends["high"]
    spread = F.greatest(high - low, F.lit(1e-12))
    place = F.least(F.lit(bins - 1), F.floor((F.col(value) - low) * bins / spread))
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(place.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def five_numbers(df: DataFrame, value: str, by: str) -> DataFrame:
    """Box-plot summary per group."""
    stats = profile_values(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by=(by,))
    return stats.select(by, "n", "min", "q1", "median", "q3", "max")
