"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfare.constants import DAY_US, FAILURE_STATE, TEST_PREVALENCE, TRAIN_PREVALENCE


def uniform(seed: int, *parts: Column | str) -> Column:
    """Repeatable uniform draw in [0, 1) from a seed and key columns; free of row order."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def age_bin(value: Column, edges: Sequence[float]) -> Column:
    """Number of edges at or below ``value`` (left-closed bins)."""
    out = F.lit(0)
    for edge in sorted(edges):
        out = out + (value >= F.lit(edge)).cast("int")
    return out


def bin_bounds(edges: Sequence[int]) -> list[tuple[int, int | None]]:
    ends = sorted(int(e) for e in edges)
    return list(zip([0, *ends], [*ends, None], strict=True))


def calibration_bin(p: Column, bins: int = 10) -> Column:
    """Right-closed equal-width bin 1..bins of a probability."""
    return F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil(p * bins))).cast("int")


def shift_prevalence(
    p: Column, *, train: float = TRAIN_PREVALENCE, test: float = TEST_PREVALENCE
) -> Column:
    """Move a probability from the training base rate to the target base rate."""
    ratio = (test / (1 - test)) / (train / (1 - train))
    odds = p / F.greatest(1 - p, F.lit(1e-10)) * F.lit(ratio)
    return odds / (1 + odds)


def clip(p: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), p))


def clean_text(name: str) -> str:
    return name.translate(str.maketrans({" ": "_", "-": "_", "/": "_", "(": None, ")": None}))


def short_label(state: Column, name: Column, width: int = 22) -> Column:
    """``state + newline + readable name`` cut to ``width`` characters."""
    text = F.translate(F.coalesce(name, state.cast("string")), "_", " ")
    cut = F.when(F.length(text) > width, F.concat(F.left(text, F.lit(width - 1)), F.lit("…"))).otherwise(text)
    return F.when(state == FAILURE_STATE, F.lit("60d inactivity\nfailure")).otherwise(
        F.concat(state.cast("string"), F.lit("\n"), cut)
    )


def whole_seconds(us: Column) -> Column:
    return F.floor(us / F.lit(1_000_000)).cast("long")


def days(us: Column) -> Column:
    return us / F.lit(float(DAY_US))


def sample_count(span_us: Column, most: int) -> Column:
    """One sample per started day of the span, between 1 and ``most``."""
    started = F.floor((span_us + F.lit(DAY_US - 1)) / F.lit(DAY_US))
    return F.least(F.lit(most), F.greatest(F.lit(1), started)).cast("int")
