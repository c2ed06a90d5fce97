"""The two journey logs of the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.sources.log import HOT_ROWS, JourneyLog, open_log

# Event name -> event id for table ``events``.  Success is "purchase"; "error" is no customer action.
EVENT_IDS = {"view": 4, "click": 2, "signup": 23, "purchase": 28, "error": 12}
# Order priority -> (event id, event name) for table ``orders``.  Status F is success.
ORDER_IDS = {
    "1-URGENT": (11, "add_to_cart"),
    "2-HIGH": (6, "begin_checkout"),
    "3-MEDIUM": (4, "browse_products"),
    "4-NOT SPECIFIED": (5, "view_cart"),
    "5-LOW": (2, "campaign_click"),
}
EVENTS_SUCCESS = "purchase"
ORDERS_SUCCESS = "order_shipped"


def _choose(column: str, values: dict) -> Column:
    out: Column | None = None
    for key, value in values.items():
        test = F.col(column) == key
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def raw_events(spark: SparkSession, folder: str) -> DataFrame:
    """Table ``events`` as id, event_timestamp, event_name, ed_id (one journey per user)."""
    return spark.read.parquet(f"{folder}/events.parquet").select(
        F.col("user_id").cast("string").alias("id"),
        F.col("ts").cast("timestamp").alias("event_timestamp"),
        F.col("event_type").alias("event_name"),
        _choose("event_type", EVENT_IDS).cast("long").alias("ed_id"),
    )


def raw_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Table ``orders`` in the same shape (one journey per customer)."""
    shipped = F.col("o_orderstatus") == "F"
    return spark.read.parquet(f"{folder}/orders.parquet").select(
        F.col("o_custkey").cast("string").alias("id"),
        F.col("o_orderdate").cast("timestamp").alias("event_timestamp"),
        F.when(shipped, ORDERS_SUCCESS)
        .otherwise(_choose("o_orderpriority", {k: v[1] for k, v in ORDER_IDS.items()}))
        .alias("event_name"),
        F.when(shipped, 28)
        .otherwise(_choose("o_orderpriority", {k: v[0] for k, v in ORDER_IDS.items()}))
        .cast("long")
        .alias("ed_id"),
    )


def events_log(spark: SparkSession, folder: str, *, hot_rows: int = HOT_ROWS) -> JourneyLog:
    return open_log(raw_events(spark, folder), hot_rows=hot_rows)


def orders_log(spark: SparkSession, folder: str, *, hot_rows: int = HOT_ROWS) -> JourneyLog:
    return open_log(raw_orders(spark, folder), hot_rows=hot_rows)
