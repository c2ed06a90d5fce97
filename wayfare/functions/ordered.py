"""Ordered computations along a journey that stay parallel when one journey is huge.

A plain window needs every row of a key in one task.  Here a key may be cut into
time-ordered slices (column ``slice``).  Each step is evaluated inside its slice, a
summary with one row per slice supplies what the earlier or later slices contribute,
and the two are combined.

A log with huge journeys is a union of two branches: ordinary rows, where ``slice`` is
the literal null, and rows of cut journeys, where it is never null.  The optimizer
folds tests on ``slice`` per branch, so ordinary rows only ever meet plain windows and
keep their placement by journey.  Without a ``slice`` column all rows are ordinary.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.session import settle

SLICE = "slice"
ORDER = ("ts_us", "ed_id", "event_name")


@dataclass(frozen=True)
class Step:
    kind: str
    value: Column | None = None
    size: int = 1


def nth() -> Step:
    """1-based position."""
    return Step("nth")


def running_sum(value: Column) -> Step:
    return Step("running_sum", value)


def running_max(value: Column) -> Step:
    return Step("running_max", value)


def previous(value: Column) -> Step:
    """Value of the row before."""
    return Step("previous", value)


def following(value: Column) -> Step:
    """Value of the row after."""
    return Step("following", value)


def latest(value: Column) -> Step:
    """Last non-null value at or before the row."""
    return Step("latest", value)


def recent(value: Column, size: int) -> Step:
    """Array of the last ``size`` values up to the row, oldest first."""
    return Step("recent", value, size)


def later_min(value: Column) -> Step:
    """Smallest value on the rows strictly after."""
    return Step("later_min", value)


def total_sum(value: Column) -> Step:
    return Step("total_sum", value)


def total_max(value: Column) -> Step:
    return Step("total_max", value)


def total_min(value: Column) -> Step:
    return Step("total_min", value)


def along(
    df: DataFrame,
    steps: Mapping[str, Step],
    *,
    key: Sequence[str] = ("id",),
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """Add one column per step, computed per ``key`` in ``order``."""
    if SLICE not in df.columns:
        return _plain(df, steps, key, order)
    ordinary = _plain(df.where(F.col(SLICE).isNull()).drop(SLICE), steps, key, order)
    # Written once per level: the slice summary and the rows both read it, so levels do not multiply.
    cut = along_slices(settle(df.where(F.col(SLICE).isNotNull())), steps, key=key, order=order)
    return both_branches(ordinary, cut)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equality join in which nulls are equal; columns of the key come from ``left``."""
    named = right.withColumnsRenamed({c: f"_on_{c}" for c in on})
    same = F.lit(True)
    for c in on:
        same &= F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    return left.join(named, same, how).drop(*[f"_on_{c}" for c in on])


def both_branches(ordinary: DataFrame, cut: DataFrame) -> DataFrame:
    """Union that lets the optimizer tell the branches apart by ``slice``."""
    return ordinary.withColumn(SLICE, F.lit(None).cast("int")).unionByName(
        cut.withColumn(SLICE, F.coalesce(SLICE, F.lit(0)))
    )


def _plain(df: DataFrame, steps: Mapping[str, Step], key: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.withColumns({name: _local(step, list(key), order, wrap=False) for name, step in steps.items()})


def along_slices(
    df: DataFrame, steps: Mapping[str, Step], *, key: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """The same steps where every row has a slice; the order must never go back to an earlier slice."""
    part = [*key, SLICE]
    out = df.withColumns({f"_in_{name}": _local(step, part, order, wrap=True) for name, step in steps.items()})
    base = out if any(step.kind == "recent" for step in steps.values()) else df
    slices = base.groupBy(*part).agg(
        *[_summary(step, order, f"_in_{name}").alias(f"_s_{name}") for name, step in steps.items()]
    )
    carried = slices.select(
        *part, *[_carry(step, f"_s_{name}", key).alias(f"_out_{name}") for name, step in steps.items()]
    )
    out = null_safe_join(out, carried, part, "left")
    out = out.withColumns(
        {name: _combine(step, F.col(f"_in_{name}"), F.col(f"_out_{name}")) for name, step in steps.items()}
    )
    return out.drop(*[f"_in_{n}" for n in steps], *[f"_out_{n}" for n in steps])


def _local(step: Step, part: Sequence[str], order: Sequence[str], *, wrap: bool) -> Column:
    forward = Window.partitionBy(*part).orderBy(*order)
    upto = forward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*part)
    value = step.value
    match step.kind:
        case "nth":
            return F.row_number().over(forward).cast("long")
        case "running_sum":
            return F.sum(value).over(upto)
        case "running_max":
            return F.max(value).over(upto)
        case "previous":
            return F.lag(F.struct(value.alias("v")) if wrap else value).over(forward)
        case "following":
            return F.lead(F.struct(value.alias("v")) if wrap else value).over(forward)
        case "latest":
            return F.last(value, ignorenulls=True).over(upto)
        case "recent":
            return F.collect_list(value).over(forward.rowsBetween(1 - step.size, Window.currentRow))
        case "later_min":
            # A frame open at the end is quadratic; the reversed order is linear.
            backward = Window.partitionBy(*part).orderBy(*[F.col(c).desc() for c in order])
            return F.min(value).over(backward.rowsBetween(Window.unboundedPreceding, -1))
        case "total_sum":
            return F.sum(value).over(whole)
        case "total_max":
            return F.max(value).over(whole)
        case "total_min":
            return F.min(value).over(whole)
    raise ValueError(f"unknown step {step.kind}")


def _summary(step: Step, order: Sequence[str], inside: str) -> Column:
    place = F.struct(*order)
    value = step.value
    match step.kind:
        case "nth":
            return F.count(F.lit(1))
        case "running_sum" | "total_sum":
            return F.sum(value)
        case "running_max" | "total_max":
            return F.max(value)
        case "later_min" | "total_min":
            return F.min(value)
        case "previous":
            return F.max_by(F.struct(value.alias("v")), place)
        case "following":
            return F.min_by(F.struct(value.alias("v")), place)
        case "latest":
            return F.max_by(value, F.when(value.isNotNull(), place))
        case "recent":
            return F.max_by(inside, place)
    raise ValueError(f"unknown step {step.kind}")


def _carry(step: Step, column: str, key: Sequence[str]) -> Column:
    forward = Window.partitionBy(*key).orderBy(SLICE)
    before = forward.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*key)
    match step.kind:
        case "nth" | "running_sum":
            return F.sum(column).over(before)
        case "running_max":
            return F.max(column).over(before)
        case "previous":
            return F.lag(column).over(forward)
        case "following":
            return F.lead(column).over(forward)
        case "latest":
            return F.last(column, ignorenulls=True).over(before)
        case "recent":
            # Every slice holds a row, so that many slices before are enough.
            near = forward.rowsBetween(-step.size, -1)
            return F.flatten(F.collect_list(column).over(near))
        case "later_min":
            backward = Window.partitionBy(*key).orderBy(F.col(SLICE).desc())
            return F.min(column).over(backward.rowsBetween(Window.unboundedPreceding, -1))
        case "total_sum":
            return F.sum(column).over(whole)
        case "total_max":
            return F.max(column).over(whole)
        case "total_min":
            return F.min(column).over(whole)
    raise ValueError(f"unknown step {step.kind}")


def _combine(step: Step, inside: Column, outside: Column) -> Column:
    match step.kind:
        case "nth":
            return inside + F.coalesce(outside, F.lit(0))
        case "running_sum":
            return F.coalesce(inside + outside, inside, outside)
        case "running_max":
            return F.greatest(inside, outside)
        case "later_min":
            return F.least(inside, outside)
        case "previous" | "following":
            return F.coalesce(inside, outside).getField("v")
        case "latest":
            return F.coalesce(inside, outside)
        case "recent":
            both = F.concat(F.coalesce(outside, F.slice(inside, 1, 0)), inside)
            return F.slice(both, -F.least(F.lit(step.size), F.size(both)), step.size)
    return F.coalesce(outside, inside)
