"""Registered queries: a Spark plan over the given tables and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.session import ship_package

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    plan: Plan
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Plan], Plan]:
    def keep(plan: Plan) -> Plan:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            # The tables hold zone-less timestamps; read them as UTC wherever the session lives.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            ship_package(spark)
            return plan(spark, folder)

        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, run, oracle)
        return plan

    return keep


def r6(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Round double columns to six places, the precision both sides are compared at."""
    kinds = dict(df.dtypes)
    wanted = [c for c in (columns or df.columns) if kinds[c] in ("double", "float")]
    return df.withColumns({c: F.round(F.col(c), 6) + F.lit(0.0) for c in wanted})
