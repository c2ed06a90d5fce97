"""State-transition tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.constants import (
    CUSTOMER_STATES,
    FAILURE_STATE,
    HORIZON_SECONDS,
    START_STATE,
    SUCCESS_STATE,
    TIMEOUT_SECONDS,
)
from wayfare.functions.columns import age_bin, bin_bounds
from wayfare.functions.ordered import (
    ORDER,
    SLICE,
    along,
    following,
    later_min,
    latest,
    nth,
    previous,
    recent,
    running_sum,
    total_max,
    total_sum,
)
from wayfare.session import settle
from wayfare.sources.log import JourneyLog


# Events of one journey that meet its snapshots in one join key (a power of two).
# Segment of a fit that is not cut into segments.
GLOBAL = "all"
WALK_BLOCK = 65_536


def _us(seconds: float) -> int:
    return int(round(seconds * 1_000_000))


def _table(rows: DataFrame, *keys: str) -> DataFrame:
    """id, seq, state, next_state, dt_us, dt_seconds (slice kept for later ordered steps)."""
    extra = [SLICE] if SLICE in rows.columns else []
    return rows.select(
        *keys, "id", "seq", "state", "next_state", "dt_us", (F.col("dt_us") / F.lit(1e6)).alias("dt_seconds"), *extra
    )


def transitions(
    log: JourneyLog,
    *,
    states: Iterable[int] | None = CUSTOMER_STATES,
    success_state: int | None = SUCCESS_STATE,
) -> DataFrame:
    """Consecutive states of each journey after the state filter; repeats of a state stay in."""
    kept = log if states is None else log.states(states, also=success_state)
    return _pairs(kept.events)


def _pairs(events: DataFrame) -> DataFrame:
    # Two flat successors: a struct per row would be built and copied by the window.
    rows = along(events, {"seq": nth(), "_next_state": following(F.col("ed_id")), "_next_us": following(F.col("ts_us"))})
    return _table(
        rows.where(F.col("_next_us").isNotNull()).select(
            "*",
            F.col("ed_id").alias("state"),
            F.col("_next_state").alias("next_state"),
            F.greatest(F.lit(0), F.col("_next_us") - F.col("ts_us")).alias("dt_us"),
        )
    )


def transitions_of(log: JourneyLog, ids: DataFrame, **options) -> DataFrame:
    """Transition table of a set of journeys (the set is applied before any ordering)."""
    return transitions(log.of(ids), **options)


def timeout_transitions(
    log: JourneyLog,
    *,
    states: Iterable[int] | None = CUSTOMER_STATES,
    success_state: int = SUCCESS_STATE,
    failure_state: int = FAILURE_STATE,
    timeout_seconds: float = TIMEOUT_SECONDS,
    horizon_seconds: float = HORIZON_SECONDS,
    end_us: Column | None = None,
) -> DataFrame:
    """Transitions of resolved journeys plus one inactivity failure per incomplete journey.

    Status, order and successor come out of one placement of the log: the last
    action of the whole journey is a total over the same groups as the successor window.
    """
    end = end_us if end_us is not None else log.end()
    rows = along(log.events, {"_end": total_max(F.struct(*ORDER))})
    success = F.col("_end.ed_id") == success_state
    idle = end - F.col("_end.ts_us") >= F.lit(_us(horizon_seconds))
    rows = rows.withColumn("_failed", ~success & idle).where(success | idle).drop("_end")
    if states is not None:
        rows = log.with_events(rows).states(states, also=success_state).events
    rows = along(rows, {"seq": nth(), "_next_state": following(F.col("ed_id")), "_next_us": following(F.col("ts_us"))})
    last = F.col("_next_us").isNull()
    rows = rows.where(~last | F.col("_failed")).select(
        "*",
        F.col("ed_id").alias("state"),
        F.when(last, F.lit(failure_state).cast("long")).otherwise(F.col("_next_state")).alias("next_state"),
        F.when(last, F.lit(_us(timeout_seconds)))
        .otherwise(F.greatest(F.lit(0), F.col("_next_us") - F.col("ts_us")))
        .alias("dt_us"),
    )
    return _table(rows.where(F.col("state") != F.col("next_state")))


def prefix_transitions(
    log: JourneyLog,
    cut: Column,
    *,
    states: Iterable[int] | None = CUSTOMER_STATES,
    success_state: int | None = SUCCESS_STATE,
) -> DataFrame:
    """Transitions within the first ``cut`` events of each journey.

    ``cut`` is an expression over ``n`` (events of the journey) and ``id``; events are
    counted before the state filter.  No join with a snapshot table is needed.
    """
    rows = along(log.events, {"_pos": nth(), "n": total_sum(F.lit(1))})
    rows = rows.where(F.col("_pos") <= cut).drop("_pos", "n")
    kept = log.with_events(rows)
    return _pairs((kept if states is None else kept.states(states, also=success_state)).events)


def state_at(log: JourneyLog, probes: DataFrame, *, keep: Sequence[str] = ("sample_num",)) -> DataFrame:
    """As-of lookup: last state at or before ``probe_us`` for rows (id, *keep, probe_us).

    Probes are merged into the event order, so a journey is read once however many probes it has.
    """
    found = _as_of(log, probes, keep, F.struct("ed_id", "ts_us", "seq")).where(F.col("_at").isNotNull())
    return found.select(
        "id", *keep, "probe_us", F.col("_at.ed_id").alias("state"), F.col("_at.ts_us").alias("state_us"), F.col("_at.seq").alias("seq")
    )


def _as_of(log: JourneyLog, probes: DataFrame, keep: Sequence[str], value: Column) -> DataFrame:
    """Merge probes into the log (behind the events of the same instant); ``_at`` is ``value`` of the last event."""
    events = along(log.events, {"seq": nth()}) if "seq" not in log.events.columns else log.events
    events = events.withColumn("_probe", F.lit(0))
    points = log.place(probes.select("id", *keep, "probe_us"), "probe_us").withColumns(
        {"_probe": F.lit(1), "ts_us": F.col("probe_us")}
    )
    merged = events.unionByName(points, allowMissingColumns=True)
    order = ("ts_us", "_probe", "ed_id", "event_name", *keep)
    step = latest(F.when(F.col("_probe") == 0, value))
    return along(merged, {"_at": step}, order=order).where(F.col("_probe") == 1)


def _walks(
    log: JourneyLog, snapshots: DataFrame, keep: Sequence[str], states: Iterable[int] | None, success_state: int, limit: int
) -> tuple[DataFrame, DataFrame]:
    """Events with what came before them, and one row per snapshot with the events its walk goes over.

    Walks: id, *keep, snapshot_us, current_state, at_seq, n, next_state and next_us (the first event ahead), last_seq and last_us (of the event
    that stops it), closed_at_start, stopped.
    """
    kept = log if states is None else log.states(states, also=success_state)
    rows = along(kept.events, {"seq": nth(), "_before": previous(F.struct("ed_id", "ts_us")), "n": total_sum(F.lit(1))})
    late = F.col("ts_us") - F.col("_before.ts_us") > limit
    rows = rows.withColumns(
        {
            "_late": F.coalesce(late, F.lit(False)),
            "_stop": F.when(F.coalesce(late, F.lit(False)) | (F.col("ed_id") == success_state), F.struct("seq", "ts_us")),
        }
    )
    rows = along(rows, {"_stop_after": later_min(F.col("_stop")), "_next": following(F.struct("ed_id", "ts_us"))})
    # Where a walk starting here ends if the very next event does not stop it.
    rows = along(rows, {"_stop_second": following(F.col("_stop_after"))})
    found = _as_of(
        log.with_events(rows.drop("_before", "_late", "_stop", "_stop_after")),
        snapshots.select("id", *keep, F.col("snapshot_us").alias("probe_us")),
        keep,
        F.struct("ed_id", "seq", "n", "_next", "_stop_second"),
    ).where(F.col("_at").isNotNull())
    at = F.col("_at")
    gap = F.greatest(F.lit(0), at["_next"]["ts_us"] - F.col("probe_us"))
    first_late = at["_next"].isNotNull() & (gap > limit)
    # The first gap counts from the snapshot, so a late mark on the next event itself does not apply.
    first_stops = at["_next"]["ed_id"] == success_state
    next_stop = F.struct((at["seq"] + 1).alias("seq"), at["_next"]["ts_us"].alias("ts_us"))
    stop = F.when(first_stops, next_stop).otherwise(at["_stop_second"])
    closed = at["_next"].isNull() | first_late
    found = found.select(
        "id",
        *keep,
        F.col("probe_us").alias("snapshot_us"),
        at["ed_id"].alias("current_state"),
        at["seq"].alias("at_seq"),
        at["n"].alias("n"),
        at["_next"]["ed_id"].alias("next_state"),
        at["_next"]["ts_us"].alias("next_us"),
        F.when(closed, at["seq"]).otherwise(F.coalesce(stop["seq"], at["n"])).alias("last_seq"),
        stop["ts_us"].alias("last_us"),
        closed.alias("closed_at_start"),
        (~first_late & at["_next"].isNotNull() & stop.isNotNull()).alias("stopped"),
    )
    return rows, found


def suffix_totals(
    log: JourneyLog,
    snapshots: DataFrame,
    *,
    segments: Sequence[str] | None = None,
    states: Iterable[int] | None = CUSTOMER_STATES,
    success_state: int = SUCCESS_STATE,
    failure_state: int = FAILURE_STATE,
    timeout_seconds: float = TIMEOUT_SECONDS,
) -> DataFrame:
    """segment, from_state, to_state, n, dwell_us over all rows of ``suffix_transitions``, without making those rows.

    A walk leaves a mark of +1 behind its first event and one of -1 behind the event that stops it, so the running sum of the marks tells at every
    event how many walks go over it, and the sum of all marks of a journey how many run out at its last event.
    First steps, whose time counts from the snapshot, come from the snapshots themselves.
    Work and storage are proportional to events plus snapshots, however far the walks go.

    With ``segments`` the snapshots have a column ``segment`` with one of these values (a few); snapshots with another or none are left out.
    """
    limit = _us(timeout_seconds)
    names = [str(x) for x in segments] if segments is not None else [GLOBAL]
    tagged = snapshots if segments is not None else snapshots.withColumn("segment", F.lit(GLOBAL))
    tagged = tagged.where(F.col("segment").cast("string").isin(names))
    rows, found = _walks(log, tagged, ("snapshot_id", "segment"), states, success_state, limit)
    found = settle(found)
    walking = found.where(~F.col("closed_at_start"))
    begun = walking.select("id", (F.col("at_seq") + 1).alias("seq"), F.col("next_us").alias("ts_us"), "segment", F.lit(1).alias("d"))
    ended = walking.where("stopped").select("id", F.col("last_seq").alias("seq"), F.col("last_us").alias("ts_us"), "segment", F.lit(-1).alias("d"))
    one = [F.sum(F.when(F.col("segment").cast("string") == x, F.col("d")).otherwise(0)).alias(f"_d{i}") for i, x in enumerate(names)]
    marks = begun.unionByName(ended).groupBy("id", "seq", "ts_us").agg(*one)
    # A mark stands behind the event of its number.
    marks = log.place(marks, "ts_us").withColumn("_mark", F.lit(1))
    merged = rows.withColumn("_mark", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    sums = {f"_over{i}": running_sum(F.coalesce(F.col(f"_d{i}"), F.lit(0))) for i in range(len(names))}
    sums |= {f"_out{i}": total_sum(F.coalesce(F.col(f"_d{i}"), F.lit(0))) for i in range(len(names))}
    events = along(merged, sums, order=("seq", "_mark")).where("_mark = 0")
    failure = F.lit(failure_state).cast("long")
    late = F.col("_late")

    def row(segment: Column, state: Column, next_state: Column, dt_us: Column, times: Column) -> Column:
        return F.struct(
            segment.cast("string").alias("segment"), state.alias("from_state"), next_state.alias("to_state"), dt_us.cast("long").alias("dt_us"), times.cast("long").alias("times")
        )

    dt_us = F.when(late, F.lit(limit)).otherwise(F.greatest(F.lit(0), F.col("ts_us") - F.col("_before.ts_us")))
    steps = []
    for i, x in enumerate(names):
        steps.append(row(F.lit(x), F.col("_before.ed_id"), F.when(late, failure).otherwise(F.col("ed_id")), dt_us, F.col(f"_over{i}")))
        steps.append(row(F.lit(x), F.col("ed_id"), failure, F.lit(limit), F.when(F.col("seq") == F.col("n"), F.col(f"_out{i}")).otherwise(0)))
    closed = F.col("closed_at_start")
    first = row(
        F.col("segment"),
        F.col("current_state"),
        F.when(closed, failure).otherwise(F.col("next_state")),
        F.when(closed, F.lit(limit)).otherwise(F.greatest(F.lit(0), F.col("next_us") - F.col("snapshot_us"))),
        F.lit(1),
    )
    every = events.select(F.inline(F.filter(F.array(*steps), lambda s: s["times"] > 0))).unionByName(found.select(first.alias("s")).select("s.*"))
    return (
        every.where(F.col("from_state") != F.col("to_state"))
        .groupBy("segment", "from_state", "to_state")
        .agg(F.sum("times").alias("n"), F.sum(F.col("times") * F.col("dt_us")).alias("dwell_us"))
    )


def suffix_transitions(
    log: JourneyLog,
    snapshots: DataFrame,
    *,
    states: Iterable[int] | None = CUSTOMER_STATES,
    success_state: int = SUCCESS_STATE,
    failure_state: int = FAILURE_STATE,
    timeout_seconds: float = TIMEOUT_SECONDS,
) -> DataFrame:
    """What happens after each snapshot (snapshot_id, id, snapshot_us).

    The walk from a snapshot ends at the first success or the first gap above the
    timeout.  Both are properties of the journey, so every event learns once where the walk
    through it ends; a snapshot only looks up its current state and that end, and then joins
    the events in between.  Work is proportional to the rows produced.
    """
    limit = _us(timeout_seconds)
    rows, found = _walks(log, snapshots, ("snapshot_id",), states, success_state, limit)
    block = F.col("seq").cast("long").bitwiseAND(F.lit(~(WALK_BLOCK - 1)))
    steps = rows.select(
        "id",
        "seq",
        block.alias("block"),
        F.col("_before.ed_id").alias("prev_state"),
        F.col("_before.ts_us").alias("prev_us"),
        "ed_id",
        "ts_us",
        "_late",
    )
    found = found.drop("next_state", "next_us", "last_us")
    # Snapshots meet events block by block, so neither side has a heavy key.
    low, high = F.col("at_seq").bitwiseAND(F.lit(~(WALK_BLOCK - 1))), F.col("last_seq")
    spread = found.withColumn("block", F.explode(F.sequence(low, high, F.lit(WALK_BLOCK).cast("long"))))
    walk = spread.alias("s").join(
        steps.alias("e"),
        (F.col("s.id") == F.col("e.id"))
        & (F.col("s.block") == F.col("e.block"))
        & (F.col("e.seq") > F.col("s.at_seq"))
        & (F.col("e.seq") <= F.col("s.last_seq")),
        "left",
    ).drop(F.col("e.id"), F.col("e.block"), F.col("s.block"))
    first = F.col("seq") == F.col("at_seq") + 1
    late_here = F.col("_late") & ~first
    from_state = F.when(first, F.col("current_state")).otherwise(F.col("prev_state"))
    from_us = F.when(first, F.col("snapshot_us")).otherwise(F.col("prev_us"))
    failure = F.lit(failure_state).cast("long")

    def row(seq: Column, state: Column, next_state: Column, dt_us: Column) -> Column:
        return F.struct(
            seq.alias("seq"), state.alias("state"), next_state.alias("next_state"), dt_us.cast("long").alias("dt_us")
        )

    move = row(
        F.col("seq"),
        from_state,
        F.when(late_here, failure).otherwise(F.col("ed_id")),
        F.when(late_here, F.lit(limit)).otherwise(F.greatest(F.lit(0), F.col("ts_us") - from_us)),
    )
    # A walk that runs out of events, or never starts, closes with an inactivity failure.
    closing = row(F.col("seq") + 1, F.col("ed_id"), failure, F.lit(limit))
    at_start = row(F.col("at_seq") + 1, F.col("current_state"), failure, F.lit(limit))
    out = walk.select(
        "snapshot_id",
        "id",
        F.inline(
            F.when(F.col("closed_at_start"), F.array(at_start))
            .when(F.col("seq").isNull(), F.slice(F.array(at_start), 1, 0))
            .when(~F.col("stopped") & (F.col("seq") == F.col("n")), F.array(move, closing))
            .otherwise(F.array(move))
        ),
    )
    return _table(out.where(F.col("state") != F.col("next_state")), "snapshot_id")


def journey_ages(table: DataFrame) -> DataFrame:
    """Age before and after each transition: running dwell time without repeats of a state."""
    rows = table.where(F.col("state") != F.col("next_state"))
    rows = along(rows, {"end_us": running_sum(F.col("dt_us"))}, order=("seq",))
    return rows.withColumn("start_us", F.col("end_us") - F.col("dt_us"))


def age_bin_exposure(table: DataFrame, edges: Sequence[float]) -> DataFrame:
    """Dwell time split over age bins, and the jump counted in the bin of its end.

    One row per transition and touched bin: id, seq, state, next_state, bin, exposure_us, jumps.
    """
    rows = journey_ages(table)
    us_edges = [_us(e) for e in sorted(edges)]
    bounds = bin_bounds(us_edges)
    first, last = age_bin(F.col("start_us"), us_edges), age_bin(F.col("end_us"), us_edges)
    rows = rows.withColumn("_last", last).withColumn("bin", F.explode(F.sequence(first, F.col("_last"))))
    low = F.element_at(F.array(*[F.lit(b[0]).cast("long") for b in bounds]), F.col("bin") + 1)
    high = F.element_at(F.array(*[F.lit(b[1]).cast("long") for b in bounds]), F.col("bin") + 1)
    overlap = F.least(F.col("end_us"), F.coalesce(high, F.col("end_us"))) - F.greatest(F.col("start_us"), low)
    return rows.select(
        "id",
        "seq",
        "state",
        "next_state",
        "bin",
        F.greatest(F.lit(0), overlap).alias("exposure_us"),
        (F.col("bin") == F.col("_last")).cast("int").alias("jumps"),
    )


def order_k_history(
    log: JourneyLog,
    order: int = 2,
    *,
    states: Iterable[int] | None = CUSTOMER_STATES,
    success_state: int = SUCCESS_STATE,
    start_state: int = START_STATE,
) -> DataFrame:
    """Last ``order`` states at every event, padded at the start; success collapses to one history."""
    if order < 2:
        raise ValueError("order must be at least 2")
    kept = log if states is None else log.states(states, also=success_state)
    rows = along(kept.events, {"seq": nth(), "_last": recent(F.col("ed_id"), order)})
    pad = F.array_repeat(F.lit(start_state).cast("long"), F.lit(order) - F.size("_last"))
    history = F.concat(pad, F.col("_last"))
    closed = F.array(*[F.lit(success_state).cast("long")] * order)
    out = rows.withColumn("history", F.when(F.col("ed_id") == success_state, closed).otherwise(history))
    return out.drop("_last")


def history_key(history: Column) -> Column:
    return F.concat_ws(",", F.transform(history, lambda x: x.cast("string")))


def order_k_transitions(log: JourneyLog, order: int = 2, **options) -> DataFrame:
    """Transitions between histories (text keys), unchanged histories dropped."""
    rows = order_k_history(log, order, **options).withColumn("_key", history_key(F.col("history")))
    rows = along(rows, {"_next_key": following(F.col("_key")), "_next_us": following(F.col("ts_us"))})
    return rows.where(F.col("_next_us").isNotNull() & (F.col("_key") != F.col("_next_key"))).select(
        "id",
        "seq",
        F.col("_key").alias("state"),
        F.col("_next_key").alias("next_state"),
        F.greatest(F.lit(0), F.col("_next_us") - F.col("ts_us")).alias("dt_us"),
    )
