"""The test tables' events as camera events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import int_div

EPOCH_US = 1_704_067_200_000_000  # fixed value: where the tables' month begins
SQUEEZE = 648_000  # fixed value: microseconds of the month for each of ours


def camera_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, packet_id, idx_in_packet, type, sec, ms, us, x, y and t_us; 30 days become 4 seconds."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = int_div(F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US, SQUEEZE)
    rows = events.select("event_id", "user_id", "event_type", t.alias("t_us"))
    kind = F.when(F.col("event_type").isin("purchase", "signup"), 1).when(F.col("event_type") == "error", 2).otherwise(0)
    return rows.select(
        F.col("event_id").alias("ord"), int_div(F.col("event_id"), 64).alias("packet_id"), (F.col("event_id") % 64).cast("int").alias("idx_in_packet"), kind.alias("type"),
        int_div(F.col("t_us"), 1_000_000).cast("int").alias("sec"), (int_div(F.col("t_us"), 1000) % 1000).cast("int").alias("ms"), (F.col("t_us") % 1000).cast("int").alias("us"),
        ((int_div(F.col("t_us"), 12_500) + F.col("event_id") % 5) % 330).cast("int").alias("x"), (F.lit(140) + F.col("user_id") % 24).cast("int").alias("y"), "t_us",
    )


def points(events: DataFrame) -> DataFrame:
    """The point-table form: x, y, t and the arrival order ord."""
    return events.select("x", "y", F.col("t_us").alias("t"), "ord")
