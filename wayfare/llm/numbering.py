"""Gapless numbers over a whole table without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.session import settle


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with a number from 0 in the given order.

    Range-partitioned by the order and written once with the number of its part; each part counts
    its own rows, the parts' counts (one row a part) are summed up front, and both are added.
    Rows equal in the whole order take their numbers in any order.
    """
    parts = settle(df.repartitionByRange(*order).withColumn("part__", F.spark_partition_id()))
    before = Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    # One row per part: at most spark.sql.shuffle.partitions rows.
    counts = parts.groupBy("part__").agg(F.count(F.lit(1)).alias("n__"))
    starts = counts.select("part__", F.coalesce(F.sum("n__").over(before), F.lit(0)).alias("start__"))
    within = Window.partitionBy("part__").orderBy(*order)
    rows = parts.withColumn("within__", F.row_number().over(within))
    joined = rows.join(F.broadcast(starts), "part__")
    return joined.withColumn(name, (F.col("start__") + F.col("within__") - 1).cast("long")).drop("part__", "start__", "within__")
