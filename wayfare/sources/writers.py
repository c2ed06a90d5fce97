"""Writing journeys, snapshots and predictions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_parquet(df: DataFrame, path: str, *, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_sharded(df: DataFrame, path: str, *, shards: int = 64, key: str = "id", only: Sequence[int] = ()) -> None:
    """Write by hash shard of ``key``; a re-run replaces just the shards it writes.

    ``only`` limits a resumed run to the given shards.  The rows of a shard may lie in several files,
    so a shard holding a very long journey is still written by many tasks.
    """
    out = df.withColumn("shard", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(shards)).cast("int"))
    if only:
        out = out.where(F.col("shard").isin([int(s) for s in only]))
    (
        out.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("shard")
        .parquet(path)
    )


def finished_shards(spark: SparkSession, path: str) -> list[int]:
    """Shards present under ``path`` (partition folder names; bounded by the shard count)."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("shard="))


def union_shards(parts: Sequence[DataFrame], *, fill_zero: bool = True) -> DataFrame:
    """Union tables whose columns differ; absent numeric columns become 0."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return merged.na.fill(0) if fill_zero else merged


def read_sharded(spark: SparkSession, path: str) -> DataFrame:
    """Read shards written at different times with different count columns."""
    return spark.read.option("mergeSchema", "true").parquet(path).na.fill(0)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header; array, struct and map columns are dropped first."""
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
    df.drop(*nested).write.mode("overwrite").csv(path, header=True)
