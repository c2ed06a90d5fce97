"""The journey log: one row per event, deduplicated, placed by journey."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions.ordered import SLICE, both_branches, null_safe_join
from wayfare.session import settle

# A journey above this many rows is cut into time slices.
HOT_ROWS = 2_000_000
# Slices aimed at per HOT_ROWS rows.
SLICES_PER_HOT_ROWS = 16
# Rows aimed at per task when the log is placed; more tasks than configured are used if needed.
ROWS_PER_TASK = 4_000_000

EVENT_COLUMNS = ("id", "event_timestamp", "event_name", "ed_id")


@dataclass(frozen=True)
class JourneyLog:
    """``events``: id, event_timestamp, event_name, ed_id, ts_us (and slice when some
    journeys are hot).  ``hot``: id and bounds (in blocks) of the journeys that were cut.
    ``end_us``: last event time of the whole raw log, kept by every subset of it."""

    events: DataFrame
    hot: DataFrame | None = None
    end_us: int | None = None

    def with_events(self, events: DataFrame) -> JourneyLog:
        """The same log with other rows (a subset, or rows with more columns)."""
        return replace(self, events=events)

    def where(self, condition: Column | str) -> JourneyLog:
        return self.with_events(self.events.where(condition))

    def of(self, ids: DataFrame) -> JourneyLog:
        """Only the journeys listed in ``ids``; cut journeys keep their placement by slice."""
        ids = ids.select("id")
        if SLICE not in self.events.columns:
            return self.with_events(self.events.join(ids, "id", "left_semi"))
        ordinary = self.events.where(F.col(SLICE).isNull()).drop(SLICE).join(ids, "id", "left_semi")
        cut = self.events.where(F.col(SLICE).isNotNull())
        # One row per slice meets the ids, never the events of a whole journey.
        slices = cut.select("id", SLICE).distinct().join(ids, "id", "left_semi")
        return self.with_events(both_branches(ordinary, cut.join(slices, ["id", SLICE], "left_semi")))

    def end(self) -> Column:
        """Dataset end in microseconds."""
        if self.end_us is not None:
            return F.lit(self.end_us)
        return self.events.select(F.max("ts_us")).scalar()

    def states(self, states, *, also: int | None = None) -> JourneyLog:
        """Keep the given event ids (and one more, usually success)."""
        wanted = sorted({int(s) for s in states} | ({int(also)} if also is not None else set()))
        return self.where(F.col("ed_id").isin(wanted))

    def place(self, rows: DataFrame, time_us: str = "ts_us") -> DataFrame:
        """Give rows keyed by (id, time) the slice their journey uses at that time."""
        if self.hot is None:
            return rows
        if SLICE in rows.columns:
            ordinary, cut = rows.where(F.col(SLICE).isNull()).drop(SLICE), rows.where(F.col(SLICE).isNotNull()).drop(SLICE)
        else:
            ids = self.hot.select("id")
            ordinary, cut = null_safe_join(rows, ids, ["id"], "left_anti"), null_safe_join(rows, ids, ["id"], "left_semi")
        return both_branches(ordinary, _with_slice(cut, self.hot, time_us))


def open_log(events: DataFrame, *, deduplicate: bool = True, hot_rows: int = HOT_ROWS) -> JourneyLog:
    """Prepare raw events for every ordered operator with one shuffle.

    Rows are placed by ``id`` (hot journeys by ``id`` and time slice).  Duplicates
    (same id, event_name, timestamp) collapse inside that placement, so neither
    the aggregate nor the later windows need another exchange.
    """
    rows = events.select(
        F.col("id").cast("string").alias("id"),
        F.unix_micros("event_timestamp").alias("ts_us"),
        F.col("event_name").cast("string").alias("event_name"),
        F.col("ed_id").cast("long").alias("ed_id"),
    )
    spans = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("ts_us").alias("hi_us"))
    # One map-side-combined pass over two columns tells the size and end of the log and its longest journey.
    found = spans.agg(
        F.max("hi_us").alias("end_us"), F.max("n").alias("longest"), F.sum("n").alias("rows")
    ).first()
    hot = _hot_journeys(rows, spans, hot_rows, found.longest) if (found.longest or 0) > hot_rows else None
    tasks = -(-(found.rows or 0) // ROWS_PER_TASK)
    if hot is None:
        return JourneyLog(_placed(rows, ["id"], tasks, deduplicate), None, found.end_us)
    ordinary = _placed(null_safe_join(rows, hot.select("id"), ["id"], "left_anti"), ["id"], tasks, deduplicate)
    cut = _with_slice(null_safe_join(rows, hot.select("id"), ["id"], "left_semi"), hot, "ts_us")
    cut = settle(_placed(cut, ["id", SLICE], tasks, deduplicate))
    return JourneyLog(both_branches(ordinary, cut), hot, found.end_us)


def _placed(rows: DataFrame, part: list[str], tasks: int, deduplicate: bool) -> DataFrame:
    configured = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Within the configured number AQE may merge small partitions; beyond it the number is explicit.
    rows = rows.repartition(*part) if tasks <= configured else rows.repartition(tasks, *part)
    if deduplicate:
        # One survivor per key, chosen by value, so a re-run keeps the same row.
        rows = rows.groupBy(*part, "ts_us", "event_name").agg(F.min("ed_id").alias("ed_id"))
    return rows.select(
        "id",
        F.timestamp_micros("ts_us").alias("event_timestamp"),
        "event_name",
        "ed_id",
        "ts_us",
        *part[1:],
    )


def _hot_journeys(rows: DataFrame, spans: DataFrame, hot_rows: int, longest: int) -> DataFrame:
    """(id, blocks) of journeys above ``hot_rows`` rows: the times at which a journey is cut, about evenly by its rows.

    The bounds are approximate quantiles of the event times, so a burst is cut as finely as it is long.  They come in
    blocks, so that a lookup reads about the square root of their number.
    """
    pieces = F.greatest(F.lit(2), F.ceil(F.col("n") * SLICES_PER_HOT_ROWS / F.lit(hot_rows)))
    ids = settle(spans.where(F.col("n") > hot_rows).select("id", pieces.cast("long").alias("pieces")))
    most = max(2, -(-longest * SLICES_PER_HOT_ROWS // hot_rows))
    at = F.percentile_approx("ts_us", [i / most for i in range(1, most)], 10 * most)
    cuts = null_safe_join(rows, ids, ["id"]).groupBy("id", "pieces").agg(at.alias("at"))
    # The longest journey keeps all bounds, a shorter one every so many.
    picked = F.filter("at", lambda _, i: F.floor((i + 1) * F.col("pieces") / most) > F.floor(i * F.col("pieces") / most))
    cuts = cuts.select("id", F.array_distinct(picked).alias("at")).where(F.size("at") > 0)
    step = F.ceil(F.sqrt(F.size("at"))).cast("int")
    starts = F.sequence(F.lit(1), F.size("at"), step)
    return settle(cuts.select("id", F.transform(starts, lambda k: F.slice("at", k, step)).alias("blocks")))


def _with_slice(rows: DataFrame, hot: DataFrame, time_us: str) -> DataFrame:
    """Slice of rows of cut journeys: the number of bounds at or before their time."""
    before = lambda bound: bound <= F.col(time_us)
    block = F.size(F.filter("blocks", lambda b: before(b[0])))
    inside = F.size(F.filter(F.get("blocks", block - 1), before))
    place = F.when(block > 0, (block - 1) * F.size(F.get("blocks", F.lit(0))) + inside).otherwise(0)
    return null_safe_join(rows, hot, ["id"]).withColumn(SLICE, F.coalesce(place, F.lit(0))).drop("blocks")
