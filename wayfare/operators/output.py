"""Aligned submissions, score matrices and saved fits."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfare.functions.columns import clip


def align_submission(template: DataFrame, predictions: DataFrame, *, p: str = "p") -> DataFrame:
    """id, order_shipped in template order (column ``ordinal``); missing scores are 0."""
    scores = predictions.select(F.col("id").cast("string").alias("id"), F.col(p).alias("_p"))
    out = template.select(F.col("id").cast("string").alias("id"), "ordinal").join(scores, "id", "left")
    return out.select("ordinal", "id", clip(F.coalesce("_p", F.lit(0.0))).alias("order_shipped")).orderBy("ordinal")


def written_order(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a written parquet table with ``ordinal``: their place from 0, files by name and rows as they stand in them."""
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    # One row per file.
    files = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(starts, "_file").withColumn("ordinal", F.col("_start") + F.col("_row")).drop("_file", "_row", "_start")


def score_matrix(long: DataFrame, models: Sequence[str], *, p: str = "p") -> DataFrame:
    """One row per id, one column per model."""
    return long.groupBy("id").pivot("model", list(models)).agg(F.max(p))


def save_fit(table: DataFrame, path: str, params: dict[str, Any]) -> None:
    """Store a rate or score table with the parameters it was fitted with."""
    table.withColumn("_params", F.lit(json.dumps(params, sort_keys=True))).write.mode("overwrite").parquet(path)


def load_fit(spark: SparkSession, path: str, params: dict[str, Any]) -> DataFrame | None:
    """The stored table if it exists and was fitted with the same parameters, else None."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    table = spark.read.parquet(path)
    first = table.select("_params").first()
    if first is None or first[0] != json.dumps(params, sort_keys=True):
        return None
    return table.drop("_params")
