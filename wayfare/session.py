"""Session settings and the shared scratch folder."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Conservative defaults: AQE sizes the reduce side, everything is UTC.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = "*", *, partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("wayfare")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    session = (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    return session


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for functions that run in Python there.

    Spark copies the archive from the driver to every executor.
    """
    context = spark.sparkContext
    if getattr(context, "_wayfare_shipped", False):
        return
    top = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for file in sorted(top.rglob("*.py")):
            archive.write(file, file.relative_to(top.parent))
    # The driver serves this file as long as it lives.
    path = Path(tempfile.mkdtemp(prefix="wayfare-")) / "wayfare.zip"
    path.write_bytes(packed.getvalue())
    context.addPyFile(str(path))
    context._wayfare_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a private one only for a local session without it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="wayfare-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage, survives lost executors, and gives the planner the true size:
    a join with a settled table broadcasts only when its files are under
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise.
    """
    return settle_at(df)[0]


def settle_at(df: DataFrame) -> tuple[DataFrame, str]:
    """``settle``, and the folder of the table, for ``forget``."""
    path = f"{_settled(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Delete one settled table that no plan reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _settled(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/settled/{spark.sparkContext.applicationId}"


def release_settled(spark: SparkSession) -> None:
    """Delete the tables this application has settled; call it when no result that reads them is needed any more."""
    forget(spark, _settled(spark))
