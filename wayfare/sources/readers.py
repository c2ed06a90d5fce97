"""Reading event logs, definitions and prepared tables, with schema checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.constants import CUSTOMER_STATES, SUCCESS_STATE

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("event_timestamp", T.StringType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("ed_id", T.LongType()),
    ]
)
DEFINITION_SCHEMA = T.StructType(
    [T.StructField("event_definition_id", T.LongType()), T.StructField("event_name", T.StringType())]
)
EVENT_STRUCT_FIELDS = ("event_timestamp", "event_name", "ed_id")
STRICT_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "table") -> DataFrame:
    """Plan-time check; reads no data."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks required columns: {missing}")
    return df


def require_struct_fields(df: DataFrame, column: str, fields: Iterable[str] = EVENT_STRUCT_FIELDS) -> DataFrame:
    """Check the element type of a nested journey column."""
    require_columns(df, [column])
    kind = df.schema[column].dataType
    element = kind.elementType if isinstance(kind, T.ArrayType) else kind
    names = set(element.names) if isinstance(element, T.StructType) else set()
    missing = sorted(set(fields) - names)
    if missing:
        raise ValueError(f"{column} lacks nested fields: {missing}")
    return df


def parse_time(column: Column | str, *, strict: bool = False) -> Column:
    """ISO-8601 text to a UTC timestamp; ``strict`` accepts the fixed second format only."""
    text = F.col(column) if isinstance(column, str) else column
    return F.try_to_timestamp(text, F.lit(STRICT_FORMAT)) if strict else F.try_to_timestamp(text)


def read_events_csv(spark: SparkSession, path: str, *, strict: bool = False) -> DataFrame:
    """Event log from CSV; the schema is given, never inferred."""
    raw = spark.read.schema(EVENT_SCHEMA).csv(path, header=True)
    return raw.withColumn("event_timestamp", parse_time("event_timestamp", strict=strict))


def read_events(spark: SparkSession, path: str, *, sample: int | None = None, seed: int = 42) -> DataFrame:
    """Event log from parquet, optionally a repeatable sample of whole journeys."""
    from wayfare.operators.clean import sample_journeys

    events = require_columns(spark.read.parquet(path), EVENT_SCHEMA.names, "event log")
    events = events.withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp"))
    return events if sample is None else sample_journeys(events, sample, seed=seed)


def read_definitions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DEFINITION_SCHEMA).csv(path, header=True)


def unknown_states(definitions: DataFrame, states: Iterable[int] = CUSTOMER_STATES) -> DataFrame:
    """Configured state ids that the definitions do not list."""
    spark = definitions.sparkSession
    wanted = spark.createDataFrame([(int(s),) for s in sorted(set(states))], "state long")
    known = definitions.select(F.col("event_definition_id").cast("long").alias("state")).distinct()
    return wanted.join(known, "state", "left_anti")


def customer_states(
    definitions: DataFrame | None = None,
    states: Iterable[int] = CUSTOMER_STATES,
    *,
    include_success: bool = False,
) -> list[int]:
    """State list, checked against the definitions when they are given."""
    chosen = sorted({int(s) for s in states} | ({SUCCESS_STATE} if include_success else set()))
    if definitions is not None:
        bad = [r.state for r in unknown_states(definitions, states).orderBy("state").collect()]
        if bad:
            raise ValueError(f"states missing from the definitions: {bad}")
    return chosen


def id_template(events: DataFrame) -> DataFrame:
    """One row per journey id with score 0."""
    return events.select(F.col("id").cast("string").alias("id")).distinct().withColumn("order_shipped", F.lit(0.0))
