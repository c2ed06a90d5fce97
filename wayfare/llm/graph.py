"""Connected components as repeated joins over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.session import settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours of each node on its smallest one: the larger neighbours, or the node and its smaller ones.

    The minimum is an aggregate that starts before the shuffle; it is written, and goes back by a join that can be split, so a
    node with very many neighbours is no group in one task.
    """
    if large:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settle(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    # Here a > b in every edge.
    least = settle(edges.groupBy("a").agg(F.min("b").alias("m")))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for undirected edges (a, b) of longs.

    Rounds go on until no edge moves; each is written to the shared folder.  Loops and repeated edges do no harm;
    a node without any edge to another one is absent.
    """
    tidy = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, seen = settle(tidy), None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if (state["n"], state["h"]) == seen:
            break
        seen = (state["n"], state["h"])
        now = settle(_star(settle(_star(now, True)), False))
    found = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found.unionAll(found.select("root").distinct().select(F.col("root").alias("node"), "root"))
