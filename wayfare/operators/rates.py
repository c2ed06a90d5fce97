"""Rate tables: counts, exposure and rates in long form, one row per segment and state pair.

A fit is one aggregation of the transitions.  The result is bounded by
segments x states x states, whatever the number of journeys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.constants import (
    FAILURE_STATE,
    MIN_BIN_TRANSITIONS,
    MIN_EXPOSURE_SECONDS,
    MIN_STATE_TRANSITIONS,
    MIN_TIME_SECONDS,
    SUCCESS_STATE,
    TIMEOUT_SECONDS,
)
from wayfare.functions.columns import age_bin
from wayfare.operators.transitions import GLOBAL, age_bin_exposure, journey_ages
from wayfare.session import settle


def us_sum(column: str) -> Column:
    """Exact sum of microseconds: 64 bits end at 292,000 years, less than the journeys of a large log have together."""
    return F.sum(F.col(column).cast("decimal(38,0)"))


def moves(table: DataFrame) -> DataFrame:
    """Transitions that change the state."""
    return table.where(F.col("state") != F.col("next_state"))


def pair_totals(table: DataFrame, segment: Column | None = None) -> DataFrame:
    """segment, from_state, to_state, n, dwell_us: the only pass over the transitions."""
    tag = (segment if segment is not None else F.lit(GLOBAL)).cast("string").alias("segment")
    return (
        moves(table)
        .groupBy(tag, F.col("state").alias("from_state"), F.col("next_state").alias("to_state"))
        .agg(F.count(F.lit(1)).alias("n"), us_sum("dt_us").alias("dwell_us"))
    )


def with_rates(totals: DataFrame, *, min_time: float = MIN_TIME_SECONDS) -> DataFrame:
    """Add exposure_us (dwell of all moves out of the state) and rate per second."""
    out_of = Window.partitionBy("segment", "from_state")
    exposure = us_sum("dwell_us").over(out_of)
    return totals.withColumn("exposure_us", exposure).withColumn(
        "rate", F.col("n") / F.greatest(F.col("exposure_us") / F.lit(1e6), F.lit(min_time))
    )


def rate_table(table: DataFrame, segment: Column | None = None) -> DataFrame:
    """Off-diagonal rates of one generator per segment."""
    return with_rates(pair_totals(table, segment))


def generator(rates: DataFrame) -> DataFrame:
    """Off-diagonal rates plus the diagonal (minus the row sum; 0 for states never left)."""
    cells = rates.select("segment", "from_state", "to_state", "rate")
    out_rate = cells.groupBy("segment", "from_state").agg(F.sum("rate").alias("out"))
    states = state_list(rates)
    diagonal = states.join(out_rate.withColumnRenamed("from_state", "state"), ["segment", "state"], "left").select(
        "segment",
        F.col("state").alias("from_state"),
        F.col("state").alias("to_state"),
        (F.lit(0.0) - F.coalesce("out", F.lit(0.0))).alias("rate"),
    )
    return cells.unionByName(diagonal)


def state_list(rates: DataFrame) -> DataFrame:
    """Distinct (segment, state) seen on either side."""
    return rates.select("segment", F.explode(F.array("from_state", "to_state")).alias("state")).distinct()


def state_grid(rates: DataFrame) -> DataFrame:
    """Every ordered state pair per segment (vocabulary-sized, through one array per segment)."""
    states = state_list(rates).groupBy("segment").agg(F.sort_array(F.collect_set("state")).alias("states"))
    one = states.select("segment", "states", F.explode("states").alias("from_state"))
    return one.select("segment", "from_state", F.explode("states").alias("to_state"))


def transition_counts(table: DataFrame, segment: Column | None = None) -> DataFrame:
    """Counts on the full state grid, zeros included."""
    totals = pair_totals(table, segment)
    return (
        state_grid(totals)
        .join(totals.drop("dwell_us"), ["segment", "from_state", "to_state"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
    )


def state_exposure(table: DataFrame, segment: Column | None = None, *, min_time: float = MIN_TIME_SECONDS) -> DataFrame:
    """Seconds spent in every state before moving on, floored for states never left."""
    totals = pair_totals(table, segment)
    left = totals.groupBy("segment", F.col("from_state").alias("state")).agg(us_sum("dwell_us").alias("us"))
    seconds = F.greatest(F.coalesce(F.col("us"), F.lit(0)) / F.lit(1e6), F.lit(min_time))
    return state_list(totals).join(left, ["segment", "state"], "left").select(
        "segment", "state", seconds.alias("exposure_seconds")
    )


def top_rates(rates: DataFrame, n: int = 15) -> DataFrame:
    """Largest off-diagonal rates."""
    out = rates.select("segment", "from_state", "to_state", "rate")
    return out.orderBy(F.desc("rate"), "segment", "from_state", "to_state").limit(n)


def smoothed_rates(
    table: DataFrame,
    *,
    alpha: float = 0.5,
    segment: Column | None = None,
    min_time: float = MIN_TIME_SECONDS,
    lift_empty_states: bool = True,
) -> DataFrame:
    """Add ``alpha`` to every off-diagonal count before dividing by exposure.

    States without exposure get alpha / min_time as in the plain definition, unless
    ``lift_empty_states`` is off (then their rows stay zero).
    """
    return smoothed_totals(pair_totals(table, segment), alpha=alpha, min_time=min_time, lift_empty_states=lift_empty_states)


def smoothed_totals(
    totals: DataFrame, *, alpha: float = 0.5, min_time: float = MIN_TIME_SECONDS, lift_empty_states: bool = True
) -> DataFrame:
    """``smoothed_rates`` from pair totals."""
    cells = (
        state_grid(totals)
        .where(F.col("from_state") != F.col("to_state"))
        .join(totals, ["segment", "from_state", "to_state"], "left")
        .na.fill(0, ["n", "dwell_us"])
    )
    exposure = us_sum("dwell_us").over(Window.partitionBy("segment", "from_state"))
    seconds = F.greatest(exposure / F.lit(1e6), F.lit(min_time))
    rate = (F.col("n") + F.lit(float(alpha))) / seconds
    if not lift_empty_states:
        rate = F.when(exposure > 0, rate).otherwise(0.0)
    return cells.withColumn("exposure_us", exposure).withColumn("rate", rate)


def absorbing_totals(
    table: DataFrame,
    segment: Column | None = None,
    *,
    success_state: int = SUCCESS_STATE,
    failure_state: int = FAILURE_STATE,
) -> DataFrame:
    """Pair totals without rows that start in success or failure."""
    return pair_totals(table.where(~F.col("state").isin(success_state, failure_state)), segment)


def semi_markov_weights(
    table: DataFrame,
    segment: Column | None = None,
    *,
    success_state: int = SUCCESS_STATE,
    failure_state: int = FAILURE_STATE,
    timeout_seconds: float = TIMEOUT_SECONDS,
) -> DataFrame:
    """Outgoing samples per state pair, split by lateness: all a value iteration needs."""
    tag = (segment if segment is not None else F.lit(GLOBAL)).cast("string").alias("segment")
    late = F.col("dt_us") > F.lit(int(timeout_seconds * 1_000_000))
    return (
        moves(table)
        .groupBy(tag, F.col("state").alias("from_state"), F.col("next_state").alias("to_state"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(late).alias("late"))
    )


def state_samples(
    table: DataFrame,
    *,
    success_state: int = SUCCESS_STATE,
    failure_state: int = FAILURE_STATE,
    timeout_seconds: float = TIMEOUT_SECONDS,
) -> DataFrame:
    """Per state: samples and how many of them are successes, failures or late."""
    return (
        moves(table)
        .groupBy("state")
        .agg(
            F.count(F.lit(1)).alias("samples"),
            F.count_if(F.col("next_state") == success_state).alias("success"),
            F.count_if(F.col("next_state") == failure_state).alias("failure"),
            F.count_if(F.col("dt_us") > F.lit(int(timeout_seconds * 1_000_000))).alias("late"),
        )
    )


def state_volume(totals: DataFrame) -> DataFrame:
    """Moves out of and into every state."""
    ends = totals.select(
        "segment",
        F.explode(
            F.array(
                F.struct(F.col("from_state").alias("state"), F.col("n").alias("n_out"), F.lit(0).cast("long").alias("n_in")),
                F.struct(F.col("to_state").alias("state"), F.lit(0).cast("long").alias("n_out"), F.col("n").alias("n_in")),
            )
        ).alias("e"),
    )
    return ends.groupBy("segment", "e.state").agg(
        F.sum("e.n_out").alias("n_out"), F.sum("e.n_in").alias("n_in"), F.sum(F.col("e.n_out") + F.col("e.n_in")).alias("volume")
    )


def success_prior(totals: DataFrame, success_state: int | str = SUCCESS_STATE) -> DataFrame:
    """Share of moves that end in success, per segment."""
    hit = F.when(F.col("to_state") == F.lit(success_state), F.col("n")).otherwise(0)
    return totals.groupBy("segment").agg((F.sum(hit) / F.sum("n")).alias("prior"))


def terminal_share(
    totals: DataFrame, *, success_state: int = SUCCESS_STATE, failure_state: int = FAILURE_STATE
) -> DataFrame:
    """Successes among terminal moves, 0 without any: the fallback of the timeout models."""
    won = F.sum(F.when(F.col("to_state") == success_state, F.col("n")).otherwise(0))
    lost = F.sum(F.when(F.col("to_state") == failure_state, F.col("n")).otherwise(0))
    return totals.groupBy("segment").agg(F.coalesce(F.try_divide(won, won + lost), F.lit(0.0)).alias("fallback"))


def journey_speed(table: DataFrame, rates: DataFrame) -> DataFrame:
    """Speed of a journey relative to the fitted exit rates: moves / expected moves.

    The exit rates are vocabulary-sized.  Per journey the weights are mergeable sums.
    """
    exit_rate = rates.groupBy(F.col("from_state").alias("state")).agg(
        F.greatest(F.sum("rate"), F.lit(1e-12)).alias("exit_rate")
    )
    per_id = (
        moves(table)
        .join(exit_rate, "state", "left")
        .groupBy("id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.coalesce("exit_rate", F.lit(0.0)) * F.col("dt_seconds")).alias("expected"),
        )
    )
    alpha = F.col("n") / F.greatest(F.col("expected"), F.lit(1e-9))
    return per_id.withColumn("alpha", alpha).withColumn(
        "log_alpha", F.log(F.least(F.lit(1e6), F.greatest(F.lit(1e-6), alpha)))
    )


def stratified_totals(
    table: DataFrame, edges: Sequence[float], *, min_rows: int = MIN_BIN_TRANSITIONS
) -> DataFrame:
    """Pair totals per age bin (age at the end of the move); thin bins take the global totals.

    Columns: segment (bin), from_state, to_state, n, dwell_us, fallback.
    """
    us_edges = [int(e * 1_000_000) for e in sorted(edges)]
    rows = journey_ages(table).withColumn("_bin", age_bin(F.col("end_us"), us_edges))
    per_bin = pair_totals(rows, F.col("_bin"))
    return fill_thin_segments(per_bin, [str(b) for b in range(len(us_edges) + 1)], min_rows=min_rows)


def fill_thin_segments(totals: DataFrame, segments: Sequence[str], *, min_rows: int) -> DataFrame:
    """Replace segments with fewer than ``min_rows`` moves by the sum over all segments."""
    size = F.sum("n").over(Window.partitionBy("segment"))
    sized = totals.withColumn("_size", size)
    kept = sized.where(F.col("_size") >= min_rows).drop("_size").withColumn("fallback", F.lit(False))
    pooled = totals.groupBy("from_state", "to_state").agg(F.sum("n").alias("n"), us_sum("dwell_us").alias("dwell_us"))
    spread = pooled.withColumn("segment", F.explode(F.array(*[F.lit(s) for s in segments])))
    full = kept.select("segment").distinct()
    thin = spread.join(full, "segment", "left_anti").withColumn("fallback", F.lit(True))
    return kept.unionByName(thin)


def piecewise_cells(
    table: DataFrame,
    edges: Sequence[float],
    *,
    success_state: int = SUCCESS_STATE,
    failure_state: int = FAILURE_STATE,
) -> DataFrame:
    """Jumps and split exposure per (bin, from_state, to_state): the one pass of a piecewise fit."""
    split = age_bin_exposure(table.where(~F.col("state").isin(success_state, failure_state)), edges)
    return split.groupBy("bin", F.col("state").alias("from_state"), F.col("next_state").alias("to_state")).agg(
        F.sum("jumps").alias("n"), us_sum("exposure_us").alias("exposure_us")
    )


def piecewise_rates(
    table: DataFrame,
    edges: Sequence[float],
    *,
    success_state: int = SUCCESS_STATE,
    failure_state: int = FAILURE_STATE,
    min_jumps: int = MIN_STATE_TRANSITIONS,
    min_exposure: float = MIN_EXPOSURE_SECONDS,
) -> DataFrame:
    """One generator row per (bin, state) from split exposure; thin rows take the global row.

    Columns: segment (bin), from_state, to_state, n, exposure_us, rate, fallback.
    """
    cells = piecewise_cells(table, edges, success_state=success_state, failure_state=failure_state)
    return piecewise_from_cells(cells, len(edges) + 1, min_jumps=min_jumps, min_exposure=min_exposure)


def piecewise_from_cells(
    cells: DataFrame,
    bins: int,
    *,
    min_jumps: int = MIN_STATE_TRANSITIONS,
    min_exposure: float = MIN_EXPOSURE_SECONDS,
) -> DataFrame:
    """The fallback rule on (bin, from_state, to_state, n, exposure_us) totals."""
    row = Window.partitionBy("bin", "from_state")
    per_bin = cells.withColumns({"_jumps": F.sum("n").over(row), "exposure_us": us_sum("exposure_us").over(row)})
    rich = per_bin.where((F.col("_jumps") >= min_jumps) & (F.col("exposure_us") >= F.lit(int(min_exposure * 1e6))))
    rich = rich.drop("_jumps").withColumn("fallback", F.lit(False))
    whole = cells.groupBy("from_state", "to_state").agg(F.sum("n").alias("n"), us_sum("exposure_us").alias("_us"))
    whole = whole.withColumn("exposure_us", us_sum("_us").over(Window.partitionBy("from_state"))).drop("_us")
    spread = whole.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    thin = spread.join(rich.select("bin", "from_state").distinct(), ["bin", "from_state"], "left_anti")
    out = rich.unionByName(thin.withColumn("fallback", F.lit(True)))
    rate = F.when(
        F.col("exposure_us") > 0, F.col("n") / F.greatest(F.col("exposure_us") / F.lit(1e6), F.lit(MIN_TIME_SECONDS))
    ).otherwise(0.0)
    return out.withColumn("rate", rate).withColumn("segment", F.col("bin").cast("string")).drop("bin")


def bin_windows(edges: Sequence[float]) -> list[str]:
    """Readable window names in days."""
    ends = sorted(edges)
    names = [f"0-{ends[0] / 86400:.0f}d"]
    names += [f"{a / 86400:.0f}-{b / 86400:.0f}d" for a, b in zip(ends, ends[1:])]
    return [*names, f"{ends[-1] / 86400:.0f}d+"]


def piecewise_summary(table: DataFrame, edges: Sequence[float], **options) -> DataFrame:
    """Per age bin: moves, exposure in days, fallback rows and states."""
    success, failure = options.get("success_state", SUCCESS_STATE), options.get("failure_state", FAILURE_STATE)
    # One row per bin and pair of states, read several times below.
    cells = settle(piecewise_cells(table, edges, success_state=success, failure_state=failure))
    bins = len(edges) + 1
    fitted = piecewise_from_cells(
        cells,
        bins,
        min_jumps=options.get("min_jumps", MIN_STATE_TRANSITIONS),
        min_exposure=options.get("min_exposure", MIN_EXPOSURE_SECONDS),
    )
    seen = cells.select(F.explode(F.array("from_state", "to_state")).alias("state")).distinct()
    n_states = seen.where(~F.col("state").isin(success, failure)).select(F.count(F.lit(1)) + 2).scalar()
    totals = cells.groupBy("bin").agg(F.sum("n").alias("n_transitions"), us_sum("exposure_us").alias("us"))
    thin = fitted.where("fallback").groupBy(F.col("segment").cast("int").alias("bin")).agg(
        F.count_distinct("from_state").alias("n_from")
    )
    # A state seen only as a target has no row anywhere; its zero global row counts as fallback.
    only_target = (
        cells.select(F.col("to_state").alias("state"))
        .distinct()
        .where(~F.col("state").isin(success, failure))
        .join(cells.select(F.col("from_state").alias("state")).distinct(), "state", "left_anti")
        .select(F.count(F.lit(1)))
        .scalar()
    )
    windows = F.array(*[F.lit(w) for w in bin_windows(edges)])
    every = table.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (
        every.join(totals, "bin", "left")
        .join(thin, "bin", "left")
        .select(
            "bin",
            F.element_at(windows, F.col("bin") + 1).alias("window"),
            F.coalesce("n_transitions", F.lit(0)).alias("n_transitions"),
            (F.coalesce("us", F.lit(0)) / F.lit(86_400e6)).alias("exposure_days"),
            (F.coalesce("n_from", F.lit(0)) + only_target).alias("n_fallback_rows"),
            n_states.alias("n_states"),
        )
    )


def stratified_summary(totals: DataFrame) -> DataFrame:
    """Per bin of a stratified fit: moves and states of the generator in use."""
    n = totals.groupBy("segment").agg(F.sum("n").alias("n_transitions"), F.bool_or("fallback").alias("fallback"))
    states = state_list(totals).groupBy("segment").agg(F.count(F.lit(1)).alias("n_states"))
    return n.join(states, "segment")


def censored_rates(
    snapshots: DataFrame, by: Sequence[str], *, horizon_seconds: float = TIMEOUT_SECONDS
) -> DataFrame:
    """Exponential success rate per group: successes / observed time, failures censored at the horizon.

    ``snapshots`` has label and remaining_seconds (null unless label = 1).
    """
    exposure = F.when(F.col("label") == 1, F.greatest(F.col("remaining_seconds"), F.lit(0.0))).otherwise(
        F.lit(float(horizon_seconds))
    )
    return snapshots.groupBy(*by).agg(
        F.sum("label").alias("successes"),
        F.sum(exposure).alias("exposure_seconds"),
        (F.sum("label") / F.greatest(F.sum(exposure), F.lit(MIN_TIME_SECONDS))).alias("rate"),
    )
