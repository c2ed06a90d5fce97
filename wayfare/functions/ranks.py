"""Exact ranks and quantiles without a global sort in one task.

Equal values are counted first, the distinct values are dealt by range into even
slices that follow the value order, and counts are accumulated slice by slice.  No
task sees more than one slice of the distinct values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions.ordered import SLICE, Step, along_slices, running_sum, total_sum
from wayfare.session import settle


def even_slices(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with a slice that follows ``order``, written once.

    Spark samples the rows for the bounds of the slices, so these are even however the values lie.
    """
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settle(rows.repartitionByRange(slices, *order).withColumn(SLICE, F.spark_partition_id()))


def sliced_running(
    counts: DataFrame,
    value: str,
    steps: Mapping[str, Step],
    *,
    by: Sequence[str] = (),
) -> DataFrame:
    """Ordered steps over distinct values (``counts`` holds one row per by + value)."""
    key = list(by) or ["_all"]
    rows = counts if by else counts.withColumn("_all", F.lit(0))
    rows = even_slices(rows, [*by, value])
    out = along_slices(rows, steps, key=key, order=[value]).drop(SLICE)
    return out if by else out.drop("_all")


def cumulative_counts(df: DataFrame, value: str, *, by: Sequence[str] = ()) -> DataFrame:
    """by, value, n, upto (rows with value <= this one), total, amount (sum of all values)."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    steps = {
        "upto": running_sum(F.col("n")),
        "total": total_sum(F.col("n")),
        "amount": total_sum(F.col("n") * F.col(value).cast("double")),
    }
    return sliced_running(counts, value, steps, by=by)


def profile_values(
    df: DataFrame,
    value: str,
    quantiles: Mapping[str, float],
    *,
    by: Sequence[str] = (),
) -> DataFrame:
    """n, mean, sample std, min, max and exact linear-interpolated quantiles per group."""
    table = cumulative_counts(df, value, by=by)
    v, n = F.col(value).cast("double"), F.col("n")
    aggregates = [
        F.sum("n").alias("n_rows"),
        F.max("amount").alias("_amount"),
        # Around the mean, so that large values that are close together keep their spread.
        F.sum(n * (v - F.col("amount") / F.col("total")) * (v - F.col("amount") / F.col("total"))).alias("_spread"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    ]
    for name, q in quantiles.items():
        at = (F.col("total") - 1) * F.lit(float(q))
        for side, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("upto") - n <= place) & (place < F.col("upto"))
            aggregates.append(F.max(F.when(hit, v)).alias(f"_{side}_{name}"))
    out = table.groupBy(*by).agg(*aggregates)
    rows = F.col("n_rows")
    mean = F.col("_amount") / rows
    columns = [
        F.col("n_rows").alias("n"),
        mean.alias("mean"),
        F.when(rows > 1, F.sqrt(F.col("_spread") / (rows - 1))).alias("std"),
        "min",
        "max",
    ]
    for name, q in quantiles.items():
        at = (rows - 1) * F.lit(float(q))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        columns.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return out.select(*by, *columns)
