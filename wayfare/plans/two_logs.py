"""Fit on one log, score another, aligned to a template; fits are kept in a versioned store and found again.

A fit is kept with what it was made from: parameters, and names, sizes and times of the files of the training log.  A second run with the same
ones reads the small fitted tables and never reads the training log.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.constants import HORIZON_SECONDS, TIMEOUT_SECONDS
from wayfare.functions.columns import clip, shift_prevalence
from wayfare.operators import assemble, scoring, transitions
from wayfare.sources.log import JourneyLog, open_log

MODELS = ("horizon", "timeout", "semi_markov")


def _digest(value: Any) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True).encode()).hexdigest()


def source_digest(df: DataFrame) -> str:
    """Digest of the files a frame reads: their names, sizes and times.  No row is read."""
    files = sorted(df.inputFiles())
    if not files:
        raise ValueError("the log does not come from files; name its source yourself")
    spark, found = df.sparkSession, []
    for name in files:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        status = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place)
        found.append([name, status.getLen(), status.getModificationTime()])
    return _digest(found)


class FitStore:
    """Fitted tables in a folder that all executors share.

    Each fit is a new version: its tables first, its manifest last, so a run that breaks off leaves nothing that is found.
    Versions are never written over.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifests(self, name: str) -> list[dict]:
        """All kept fits of a name, oldest first."""
        place, fs = self._path(f"{self.folder}/{name}/manifests")
        if not fs.exists(place):
            return []
        rows = self.spark.read.text(str(place), wholetext=True).collect()
        return sorted((json.loads(r["value"]) for r in rows), key=lambda m: m["version"])

    def find(self, name: str, params: Mapping[str, Any], source: str) -> dict[str, DataFrame] | None:
        """Tables of the newest fit with these parameters and this source."""
        for m in reversed(self.manifests(name)):
            if m["params"] == json.loads(json.dumps(params)) and m["source"] == source:
                return {t: self.spark.read.schema(ddl).parquet(path) for t, (path, ddl) in m["tables"].items()}
        return None

    def keep(self, name: str, params: Mapping[str, Any], source: str, tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        """Write a new version and read it back."""
        version = max((m["version"] for m in self.manifests(name)), default=0) + 1
        while True:
            place, fs = self._path(f"{self.folder}/{name}/claims/{version:06d}")
            # Whoever makes the file first has the version.
            if fs.createNewFile(place):
                break
            version += 1
        entries = {}
        for table, df in tables.items():
            path = f"{self.folder}/{name}/{version:06d}/{table}"
            df.write.parquet(path)
            entries[table] = (path, ", ".join(f"`{c}` {t}" for c, t in df.dtypes))
        manifest = {"version": version, "name": name, "params": dict(params), "source": source, "tables": entries}
        draft, fs = self._path(f"{self.folder}/{name}/drafts/{version:06d}.json")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        final, _ = self._path(f"{self.folder}/{name}/manifests/{version:06d}.json")
        fs.mkdirs(final.getParent())
        fs.rename(draft, final)
        return {t: self.spark.read.schema(ddl).parquet(path) for t, (path, ddl) in entries.items()}


def fit_chains(log: JourneyLog, *, timeout_seconds: float, label_horizon_seconds: float, late_seconds: float) -> dict[str, DataFrame]:
    """Totals of the horizon model, the absorbing model and the weights of the semi-Markov model."""
    failing = transitions.timeout_transitions(log, timeout_seconds=timeout_seconds, horizon_seconds=label_horizon_seconds)
    return {
        "horizon": scoring.fitted_totals(transitions.transitions(log)),
        "timeout": scoring.timeout_totals(failing),
        "semi_markov": scoring.fitted_weights(failing, timeout_seconds=late_seconds),
    }


def score_journeys(journeys: DataFrame, fit: Mapping[str, DataFrame], *, horizon_seconds: float) -> DataFrame:
    """id and one score per model and their blend for journeys (id, current_state)."""
    out = scoring.horizon_score(journeys.select("id", "current_state"), fit["horizon"], horizon_seconds=horizon_seconds).withColumnRenamed("p", "horizon")
    out = scoring.timeout_score(out, fit["timeout"]).withColumnRenamed("p", "timeout")
    out = scoring.semi_markov_score(out, fit["semi_markov"]).withColumnRenamed("p", "semi_markov")
    return scoring.blend(out, list(MODELS)).select("id", *MODELS, "blend")


def two_log_scores(
    training: DataFrame,
    scoring_events: DataFrame,
    template: DataFrame,
    store: FitStore,
    *,
    name: str = "chains",
    source: str | None = None,
    horizon_seconds: float = HORIZON_SECONDS,
    timeout_seconds: float = TIMEOUT_SECONDS,
    label_horizon_seconds: float = HORIZON_SECONDS,
    late_seconds: float | None = None,
    train_prevalence: float | None = None,
    test_prevalence: float | None = None,
    opened: Callable[[DataFrame], JourneyLog] = open_log,
) -> DataFrame:
    """ordinal, id and a column per model for every row of ``template`` (ordinal, id), in its order.

    ``training`` and ``scoring_events`` are raw events (id, event_timestamp, event_name, ed_id).  Ids without events score 0; states that
    the training log has not seen take each model's fallback.  With both prevalences the scores are shifted from one to the other.
    """
    params = {"timeout_seconds": timeout_seconds, "label_horizon_seconds": label_horizon_seconds, "late_seconds": timeout_seconds if late_seconds is None else late_seconds}
    made_from = source or source_digest(training)
    fit = store.find(name, params, made_from)
    if fit is None:
        fit = store.keep(name, params, made_from, fit_chains(opened(training), **params))
    scores = score_journeys(assemble.current_state(opened(scoring_events)), fit, horizon_seconds=horizon_seconds)
    columns = [*MODELS, "blend"]
    if train_prevalence is not None and test_prevalence is not None:
        scores = scores.withColumns({c: shift_prevalence(F.col(c), train=train_prevalence, test=test_prevalence) for c in columns})
    scores = scores.withColumnRenamed("id", "_id")
    rows = template.select("ordinal", F.col("id").cast("string").alias("id"))
    joined = rows.join(scores, F.col("id") == F.col("_id"), "left")
    return joined.select("ordinal", "id", *[clip(F.coalesce(c, F.lit(0.0))).alias(c) for c in columns]).orderBy("ordinal")
