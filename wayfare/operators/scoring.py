"""Scores: state tables from fitted rates, and how journeys look them up."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.constants import FAILURE_STATE, HORIZON_SECONDS, SUCCESS_STATE, TIMEOUT_SECONDS
from wayfare.functions import chains
from wayfare.functions.columns import age_bin, clip
from wayfare.functions.ordered import along, nth, previous, total_min
from wayfare.operators import rates as R
from wayfare.session import settle
from wayfare.sources.log import JourneyLog

# A model table handed to Python tasks may hold at most this many rows.
MODEL_ROWS = 2_000_000


def per_segment(table: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], columns: str) -> DataFrame:
    """Run a NumPy kernel on the rate table of each segment (bounded by states squared)."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = kernel(pdf)
        out.insert(0, "segment", key[0])
        return out

    return table.groupBy("segment").applyInPandas(run, f"segment string, {columns}")


def _state_type(table: DataFrame) -> str:
    return dict(table.dtypes)["from_state"]


def transition_probabilities(rates: DataFrame, horizon_seconds: float) -> DataFrame:
    """exp(Q t) as (segment, from_state, to_state, p)."""
    kind = _state_type(rates)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        states, q = chains.dense(pdf)
        p = chains.transition_matrix(q, horizon_seconds)
        n = len(states)
        return pd.DataFrame({"from_state": np.repeat(states, n), "to_state": np.tile(states, n), "p": p.ravel()})

    return per_segment(rates, kernel, f"from_state {kind}, to_state {kind}, p double")


def horizon_table(rates: DataFrame, *, success_state=SUCCESS_STATE, horizon_seconds: float = HORIZON_SECONDS) -> DataFrame:
    """P(success within the horizon) per segment and state."""
    return per_segment(
        rates,
        lambda pdf: chains.horizon_hits(pdf, success_state, horizon_seconds),
        f"state {_state_type(rates)}, p double",
    )


def timeout_table(
    totals: DataFrame, *, success_state: int = SUCCESS_STATE, failure_state: int = FAILURE_STATE
) -> DataFrame:
    """P(success before inactivity failure) per segment and state, from absorbing totals."""
    return per_segment(
        R.with_rates(totals), lambda pdf: chains.absorption(pdf, success_state, failure_state), "state long, p double"
    )


def semi_markov_table(
    weights: DataFrame, *, success_state: int = SUCCESS_STATE, failure_state: int = FAILURE_STATE
) -> DataFrame:
    return per_segment(
        weights, lambda pdf: chains.value_iteration(pdf, success_state, failure_state), "state long, p double"
    )


def hitting_table(rates: DataFrame, *, success_state: int = SUCCESS_STATE) -> DataFrame:
    """Expected seconds to success per segment and state."""
    return per_segment(rates, lambda pdf: chains.hitting_time(pdf, success_state), "state long, seconds double")


def look_up(
    journeys: DataFrame,
    table: DataFrame,
    fallback: Column,
    *,
    value: str = "p",
    state: str = "current_state",
    segment: str | None = None,
) -> DataFrame:
    """Attach ``value`` of the journey's state (and segment); unmatched rows take ``fallback``.

    The table is vocabulary-sized; the planner broadcasts it by its known file size.
    """
    renamed = table.withColumnsRenamed({"state": state, value: "_value"})
    if segment is None:
        keyed, on = renamed.drop("segment"), [state]
    else:
        keyed, on = renamed.withColumnRenamed("segment", segment), [segment, state]
    return journeys.join(keyed, on, "left").withColumn(value, F.coalesce("_value", fallback)).drop("_value")


def _one(table: DataFrame, column: str) -> Column:
    return table.where(F.col("segment") == R.GLOBAL).select(column).scalar()


def horizon_score(
    journeys: DataFrame, totals: DataFrame, *, success_state: int = SUCCESS_STATE, horizon_seconds: float = HORIZON_SECONDS
) -> DataFrame:
    """P(success within the horizon | current state); unknown states take the success prior."""
    table = horizon_table(R.with_rates(totals), success_state=success_state, horizon_seconds=horizon_seconds)
    prior = F.coalesce(_one(R.success_prior(totals, success_state), "prior"), F.lit(0.0))
    return look_up(journeys, table, prior).withColumn("p", clip(F.col("p")))


def timeout_score(
    journeys: DataFrame, totals: DataFrame, *, success_state: int = SUCCESS_STATE, failure_state: int = FAILURE_STATE
) -> DataFrame:
    """P(success before inactivity failure | current state); unknown states take the terminal share."""
    table = timeout_table(totals, success_state=success_state, failure_state=failure_state)
    share = R.terminal_share(totals, success_state=success_state, failure_state=failure_state)
    return look_up(journeys, table, F.coalesce(_one(share, "fallback"), F.lit(0.0)))


def semi_markov_score(
    journeys: DataFrame, weights: DataFrame, *, success_state: int = SUCCESS_STATE, failure_state: int = FAILURE_STATE
) -> DataFrame:
    table = semi_markov_table(weights, success_state=success_state, failure_state=failure_state)
    share = R.terminal_share(weights, success_state=success_state, failure_state=failure_state)
    return look_up(journeys, table, F.coalesce(_one(share, "fallback"), F.lit(0.0)))


def hitting_time(journeys: DataFrame, totals: DataFrame, *, success_state: int = SUCCESS_STATE) -> DataFrame:
    """Expected seconds to success; unknown states never get there."""
    return look_up(
        journeys, hitting_table(R.with_rates(totals), success_state=success_state), F.lit(float("inf")), value="seconds"
    )


def waiting_score(seconds: Column, horizon_seconds: float = HORIZON_SECONDS) -> Column:
    """Score of the waiting-time rule: exp(-expected time / horizon)."""
    return F.exp(-F.least(seconds, F.lit(1e12)) / F.lit(float(horizon_seconds)))


def _segment_or_global(
    journeys: DataFrame, segment_table: DataFrame, unknown_state: DataFrame, global_scores: Column, segment: str, value: str
) -> DataFrame:
    """Segment value; unknown state in a known segment -> that segment's fallback; unknown segment -> global."""
    out = look_up(journeys, segment_table, F.lit(None).cast("double"), value=value, segment=segment)
    fallback = unknown_state.select(F.col("segment").alias(segment), F.col("fallback").alias("_fallback"))
    out = out.join(fallback, segment, "left")
    return out.withColumn(value, F.coalesce(value, "_fallback", global_scores)).drop("_fallback")


def segment_score(
    journeys: DataFrame,
    totals: DataFrame,
    global_totals: DataFrame,
    *,
    segment: str = "segment",
    success_state: int = SUCCESS_STATE,
    horizon_seconds: float = HORIZON_SECONDS,
) -> DataFrame:
    """Horizon score of each journey's own segment; journeys of an unfitted segment use the global model."""
    base = horizon_score(journeys, global_totals, success_state=success_state, horizon_seconds=horizon_seconds)
    base = base.withColumnRenamed("p", "_global")
    table = horizon_table(R.with_rates(totals), success_state=success_state, horizon_seconds=horizon_seconds)
    unknown = R.success_prior(totals, success_state).withColumnRenamed("prior", "fallback")
    return _segment_or_global(base, table, unknown, F.col("_global"), segment, "p").drop("_global")


def segment_timeout_score(
    journeys: DataFrame, totals: DataFrame, global_totals: DataFrame, *, segment: str = "segment"
) -> DataFrame:
    base = timeout_score(journeys, global_totals).withColumnRenamed("p", "_global")
    out = _segment_or_global(base, timeout_table(totals), R.terminal_share(totals), F.col("_global"), segment, "p")
    return out.drop("_global")


def segment_hitting_time(
    journeys: DataFrame, totals: DataFrame, global_totals: DataFrame, *, segment: str = "segment"
) -> DataFrame:
    base = hitting_time(journeys, global_totals).withColumnRenamed("seconds", "_global")
    table = hitting_table(R.with_rates(totals))
    unknown = totals.select("segment").distinct().withColumn("fallback", F.lit(float("inf")))
    return _segment_or_global(base, table, unknown, F.col("_global"), segment, "seconds").drop("_global")


def stratified_score(
    journeys: DataFrame,
    totals: DataFrame,
    edges: Sequence[float],
    *,
    success_state: int = SUCCESS_STATE,
    horizon_seconds: float = HORIZON_SECONDS,
    age: str = "observed_age_seconds",
) -> DataFrame:
    """Horizon score under the generator of the journey's current age bin (``totals`` per bin)."""
    rows = journeys.withColumn("age_bin", age_bin(F.col(age), edges).cast("string"))
    table = horizon_table(R.with_rates(totals), success_state=success_state, horizon_seconds=horizon_seconds)
    prior = R.success_prior(totals, success_state).select(F.col("segment").alias("age_bin"), "prior")
    out = look_up(rows, table, F.lit(None).cast("double"), segment="age_bin").join(prior, "age_bin", "left")
    return out.withColumn("p", clip(F.coalesce("p", "prior", F.lit(0.0)))).drop("prior")


def order_k_score(
    histories: DataFrame,
    totals: DataFrame,
    first_order_totals: DataFrame,
    order: int,
    *,
    success_state: int = SUCCESS_STATE,
    horizon_seconds: float = HORIZON_SECONDS,
) -> DataFrame:
    """Score by history key; a history never seen falls back to the first-order score of its last state."""
    goal = ",".join([str(success_state)] * order)
    rates = R.with_rates(totals).where(F.col("from_state") != goal)
    table = per_segment(rates, lambda pdf: chains.goal_hits(pdf, goal, horizon_seconds), f"state {_state_type(rates)}, p double")
    base = horizon_score(histories, first_order_totals, success_state=success_state, horizon_seconds=horizon_seconds)
    base = base.withColumnRenamed("p", "_first")
    return look_up(base, table, F.col("_first"), state="history").drop("_first").withColumn("p", clip(F.col("p")))


def model_rows(table: DataFrame, limit: int = MODEL_ROWS) -> pd.DataFrame:
    """A vocabulary-sized model table for use inside Python tasks; refuses anything larger."""
    rows = table.limit(limit + 1).toPandas()
    if len(rows) > limit:
        raise ValueError(f"model table has more than {limit} rows; it does not depend on states alone")
    return rows


def _with_p(df: DataFrame) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField("p", T.DoubleType())])


class Ladder:
    """Propagators exp(Q u 2^j) for one generator; any time is a product of a few of them."""

    def __init__(self, q: np.ndarray, longest: float) -> None:
        self.q = q
        self.top = float(-q.diagonal().min()) if len(q) else 0.0
        self.unit = 1.0 / self.top if self.top > 0 else np.inf
        self.steps: list[np.ndarray] = []
        if self.top > 0:
            m = chains.transition_matrix(q, self.unit)
            reach = max(longest, 0.0) / self.unit
            for _ in range(max(1, int(np.ceil(np.log2(reach + 2))) + 1)):
                self.steps.append(m)
                m = m @ m

    def advance(self, rows: np.ndarray, seconds: np.ndarray) -> np.ndarray:
        """Move each probability row forward by its own time."""
        if self.top <= 0 or not len(rows):
            return rows
        count = np.floor(seconds / self.unit).astype(np.int64)
        load = seconds / self.unit - count
        step = np.eye(len(self.q)) + self.q / self.top
        term, weight = rows, np.exp(-load)
        out = term * weight[:, None]
        for k in range(1, 26):
            term = term @ step
            weight = weight * load / k
            out = out + term * weight[:, None]
        for j, m in enumerate(self.steps):
            hit = (count >> j) & 1 == 1
            if hit.any():
                out[hit] = out[hit] @ m
        return out


def piecewise_score(
    journeys: DataFrame,
    rates: DataFrame,
    edges: Sequence[float],
    fallback: Column,
    *,
    success_state: int = SUCCESS_STATE,
    failure_state: int = FAILURE_STATE,
    horizon_seconds: float = HORIZON_SECONDS,
    age: str = "observed_age_seconds",
) -> DataFrame:
    """P(success within the horizon) when the generator changes with journey age.

    Each Arrow batch is advanced bin by bin with shared propagators; nothing is solved per row.
    """
    model = model_rows(rates.select("segment", "from_state", "to_state", "rate"))
    ends = [float(e) for e in sorted(edges)]
    states, _ = chains.dense(model, (success_state, failure_state))
    at = int(np.searchsorted(states, success_state))
    base = pd.DataFrame({"from_state": states, "to_state": states, "rate": 0.0})
    ladders = []
    for b in range(len(ends) + 1):
        part = model[(model["segment"] == str(b)) & ~model["from_state"].isin([success_state, failure_state])]
        ladders.append(Ladder(chains.dense(pd.concat([part, base]))[1], horizon_seconds))
    bounds = list(zip([0.0, *ends], [*ends, np.inf], strict=True))

    def run(batches):
        for pdf in batches:
            state = pdf["current_state"].to_numpy()
            place = np.clip(np.searchsorted(states, state), 0, len(states) - 1)
            known = states[place] == state
            begin = np.maximum(pdf[age].to_numpy(dtype=float), 0.0)
            stop = begin + horizon_seconds
            p = np.zeros((len(pdf), len(states)))
            p[np.arange(len(pdf)), place] = 1.0
            for ladder, (low, high) in zip(ladders, bounds, strict=True):
                inside = np.clip(np.minimum(stop, high) - np.maximum(begin, low), 0.0, None)
                hit = inside > 0
                if hit.any():
                    p[hit] = ladder.advance(p[hit], inside[hit])
            pdf["p"] = np.where(known, np.clip(p[:, at], 0.0, 1.0), np.nan)
            yield pdf

    out = journeys.mapInPandas(run, _with_p(journeys))
    return out.withColumn("p", F.when(F.isnan("p") | F.col("p").isNull(), fallback).otherwise(F.col("p")))


def speed_score(
    journeys: DataFrame,
    rates: DataFrame,
    *,
    success_state: int = SUCCESS_STATE,
    horizon_seconds: float = HORIZON_SECONDS,
    log_alpha: str = "log_alpha",
) -> DataFrame:
    """exp(alpha Q t) per journey: the speed factor stretches the horizon; unknown states score 0."""
    model = model_rows(rates.select("from_state", "to_state", "rate"))
    states, q = chains.dense(model)
    if success_state not in states:
        return journeys.withColumn("p", F.lit(0.0))
    at = int(np.searchsorted(states, success_state))
    q[at] = 0.0
    ladder = Ladder(q, horizon_seconds * float(np.exp(6.0)))

    def run(batches):
        for pdf in batches:
            state = pdf["current_state"].to_numpy()
            place = np.clip(np.searchsorted(states, state), 0, len(states) - 1)
            p = np.zeros((len(pdf), len(states)))
            p[np.arange(len(pdf)), place] = 1.0
            speed = np.exp(np.clip(pdf[log_alpha].to_numpy(dtype=float), -6, 6))
            p = ladder.advance(p, speed * horizon_seconds)
            pdf["p"] = np.where(states[place] == state, np.clip(p[:, at], 0.0, 1.0), 0.0)
            yield pdf

    return journeys.mapInPandas(run, _with_p(journeys))


def blend(scores: DataFrame, columns: Sequence[str], name: str = "blend") -> DataFrame:
    """Mean of several score columns."""
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return scores.withColumn(name, total / F.lit(float(len(columns))))


def probability_path(log: JourneyLog, table: DataFrame, fallback: Column) -> DataFrame:
    """Score after each event, elapsed days, change from the event before and its direction.

    ``table`` gives p per state; ``log`` should hold the plotted states only.
    """
    rows = look_up(log.events.withColumn("current_state", F.col("ed_id")), table, fallback)
    rows = along(rows, {"seq": nth(), "_prev": previous(F.col("p")), "_start": total_min(F.col("ts_us"))})
    change = F.coalesce(F.col("p") - F.col("_prev"), F.lit(0.0))
    return rows.select(
        "id",
        "seq",
        "ed_id",
        "p",
        ((F.col("ts_us") - F.col("_start")) / F.lit(86_400e6)).alias("elapsed_days"),
        change.alias("delta"),
        F.when(change > 0, "up").when(change < 0, "down").otherwise("flat").alias("direction"),
    )


def path_candidates(
    log: JourneyLog, table: DataFrame, fallback: Column, *, success_state: int = SUCCESS_STATE, min_actions: int = 4
) -> DataFrame:
    """Journeys worth drawing: score range, success flag, at least ``min_actions`` events."""
    rows = look_up(log.events.withColumn("current_state", F.col("ed_id")), table, fallback)
    out = rows.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_actions"),
        F.min("p").alias("p_min"),
        F.max("p").alias("p_max"),
        (F.max("p") - F.min("p")).alias("p_range"),
        F.bool_or(F.col("ed_id") == success_state).alias("reached_success"),
    )
    return out.where(F.col("n_actions") >= min_actions)


def state_distribution(rates: DataFrame, start: Mapping[int, float], grid_seconds: Sequence[float]) -> DataFrame:
    """p0 exp(Q t) on a time grid: (segment, t_seconds, state, p)."""
    p0 = {int(k): float(v) for k, v in start.items()}
    times = [float(t) for t in grid_seconds]

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        states, q = chains.dense(pdf)
        first = np.array([p0.get(int(s), 0.0) for s in states])
        rows = np.vstack([first @ chains.transition_matrix(q, t) for t in times])
        return pd.DataFrame(
            {"t_seconds": np.repeat(times, len(states)), "state": np.tile(states, len(times)), "p": rows.ravel()}
        )

    return per_segment(rates, kernel, "t_seconds double, state long, p double")


def top_states_by_peak(distribution: DataFrame, k: int = 8) -> DataFrame:
    peaks = distribution.groupBy("segment", "state").agg(F.max("p").alias("peak"))
    rank = F.row_number().over(Window.partitionBy("segment").orderBy(F.desc("peak"), "state"))
    return peaks.withColumn("rank", rank).where(F.col("rank") <= k)


def top_states_per_time(distribution: DataFrame, k: int = 3) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("segment", "t_seconds").orderBy(F.desc("p"), "state"))
    return distribution.withColumn("rank", rank).where(F.col("rank") <= k)


def score_by_state(tables: Mapping[str, DataFrame]) -> DataFrame:
    """State x model matrix from several state tables."""
    long: DataFrame | None = None
    for name, table in tables.items():
        part = table.select(F.lit(name).alias("model"), "state", "p")
        long = part if long is None else long.unionByName(part)
    return long.groupBy("state").pivot("model", list(tables)).agg(F.max("p"))


def exponential_score(rate: Column, seconds: float = HORIZON_SECONDS) -> Column:
    """P(success within t) under a constant success rate."""
    return 1 - F.exp(-rate * F.lit(float(seconds)))


def timeout_totals(table: DataFrame, segment: Column | None = None, **options) -> DataFrame:
    """Absorbing totals written once; every score of the fit reads the small table."""
    return settle(R.absorbing_totals(table, segment, **options))


def fitted_totals(table: DataFrame, segment: Column | None = None) -> DataFrame:
    return settle(R.pair_totals(table, segment))


def fitted_weights(table: DataFrame, segment: Column | None = None, *, timeout_seconds: float = TIMEOUT_SECONDS) -> DataFrame:
    return settle(R.semi_markov_weights(table, segment, timeout_seconds=timeout_seconds))
