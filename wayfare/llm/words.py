"""Column expressions over words, lines and rows, shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space that parts words, as trim set and as pattern.
BLANKS = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order; none for a null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def shingles(w: Column, width: int, of: Callable[..., Column]) -> Column:
    """``of(word, word, ...)`` for every run of ``width`` words; the whole sequence, joined by blanks, when
    there are fewer, nothing when there are none.  ``w`` must be cheap to name often (see ``let``)."""
    several = F.transform(
        F.sequence(F.lit(0), F.size(w) - width), lambda i: of(*(F.get(w, i + k) for k in range(width)))
    )
    few = F.array(of(F.array_join(w, " ")))
    return F.when(F.size(w) >= width, several).when(F.size(w) > 0, few).otherwise(F.array().cast("array<bigint>"))


def kept_row(docs: DataFrame, **more: Column) -> DataFrame:
    """All columns of ``docs`` as one struct ``row`` beside computed ones: no name can clash."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(c.alias(k) for k, c in more.items()))
