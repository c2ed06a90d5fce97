"""Mixing sources to target weights.

Tokens are added up per source, targets follow from the weights, and each document is emitted
floor(rate) times plus one Bernoulli copy whose draw is a hash of seed and document, with the fraction
of the rate as its probability.  Only DataFrame functions; the document table is never shuffled unless the
table of sources is too large to broadcast by its file size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.numbering import numbered
from wayfare.llm.words import kept_row, n_words
from wayfare.session import settle

CYCLE = (5, 2, 1)


def source_sizes(docs: DataFrame) -> DataFrame:
    """source, source_size: words per source.  A null source is a source; a null text has no words."""
    return docs.groupBy(docs["source"].alias("source")).agg(F.sum(n_words(docs["text"])).alias("source_size"))


def cycled_weights(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """Weights by place in code point order of the sources, null last: the cycle, repeating."""
    placed = numbered(sizes, [F.col("source").asc_nulls_last()], "place")
    return placed.withColumn("weight", F.element_at(F.lit(list(cycle)), (F.col("place") % len(cycle) + 1).cast("int")).cast("long")).drop("place")


def source_targets(weighted: DataFrame, *, share: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_size, target for (source, source_size, weight).

    ``share`` of all words is dealt by weight; no target exceeds ``most`` times its source, and what is cut off
    goes to the others by weight until none is above.  Each round is one aggregate with one row as result;
    a source that is full stays full, so the rounds end.  An empty table gives no rows, empty sources the target 0.
    """
    weighted = settle(weighted)
    cap = F.col("source_size") * most
    full = F.lit(False)
    level, rounds = None, -1
    while rounds != level:
        rounds = level
        got = weighted.agg(
            F.sum("source_size").alias("words"), F.sum(F.when(full, cap)).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("weight")
        ).first()
        level = (share * (got["words"] or 0) - (got["full"] or 0)) / got["weight"] if got["weight"] else 0.0
        if rounds is not None:
            level = max(level, rounds)
        full = cap <= F.col("weight") * level
    target = F.least(cap.cast("double"), F.col("weight") * F.lit(float(level)))
    return weighted.select("source", "source_size", target.alias("target"))


def draw(seed: int, *parts: Column) -> Column:
    """Uniform in [0, 1) from a hash of seed and parts, the same in every run and engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(16**13))


def mixed(docs: DataFrame, *, seed: int = 42, share: float = 1.5, most: int = 2, targets: DataFrame | None = None) -> DataFrame:
    """Per row of ``docs``: ``row`` (all its columns), size, source_size, target and ``copies``.

    Repeated rows have the same id and size, so they share one draw; a null id is drawn by size.
    Rows of a source without words are taken as often as the rate 0 says: never.
    """
    if targets is None:
        targets = source_targets(cycled_weights(source_sizes(docs)), share=share, most=most)
    # One row per source, written: it is broadcast only if its files are small, else both sides are shuffled.
    targets = settle(targets).select(F.col("source").alias("t_source"), "source_size", "target")
    rows = kept_row(docs, source__=docs["source"], id__=docs["doc_id"], size=n_words(docs["text"]))
    rows = rows.join(targets, F.col("source__").eqNullSafe(F.col("t_source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = (draw(seed, F.col("id__"), F.col("size")) < rate - F.floor(rate)).cast("long")
    return rows.select("row", "size", "source_size", "target", (F.floor(rate) + extra).cast("long").alias("copies"))


def mix(docs: DataFrame, *, seed: int = 42, share: float = 1.5, most: int = 2) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``."""
    taken = mixed(docs, seed=seed, share=share, most=most).where("copies > 0")
    rows = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy__"))
    return rows.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
