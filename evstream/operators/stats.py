"""Throughput, window and packet statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.packets import EVENT_BYTES, HEADER, MAGIC

OVERHEAD = len(MAGIC) + HEADER.size


def throughput(packets: DataFrame, elapsed_s: float) -> DataFrame:
    """Totals of packets (event_count) and their rates a second (MB of 10^6 bytes); 0 where no time has passed."""
    sums = packets.agg(F.count("*").alias("packets"), F.coalesce(F.sum("event_count"), F.lit(0)).alias("events"))
    sums = sums.withColumn("payload_bytes", F.col("events") * EVENT_BYTES).withColumn("protocol_bytes", F.col("payload_bytes") + F.col("packets") * OVERHEAD)
    rate = lambda c, unit=1.0: F.col(c) / F.lit(unit * elapsed_s) if elapsed_s > 0 else F.lit(0.0)
    return sums.select("*", rate("packets").alias("packets_per_s"), rate("events").alias("events_per_s"), rate("payload_bytes", 1e6).alias("payload_mb_per_s"), rate("protocol_bytes", 1e6).alias("protocol_mb_per_s"))


def window_stats(events: DataFrame, window_s: float, pixels: int) -> DataFrame:
    """events, events a second of the configured (not the actual) window, touched pixels and their share."""
    sums = events.groupBy("y", "x").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events"), F.count("*").alias("active_px"))
    return sums.select("events", (F.col("events") / F.lit(float(window_s))).alias("events_per_s"), "active_px", (F.col("active_px") / F.lit(float(pixels))).alias("active_share"))


def packet_probe(events: DataFrame, packets: int = 3, types: int = 10) -> DataFrame:
    """Of the first packets: their distinct types (the lowest few) and the ranges of x and y."""
    first = events.select("packet_id").distinct().orderBy("packet_id").limit(packets)
    rows = events.join(F.broadcast(first), "packet_id", "left_semi")
    kinds = F.slice(F.sort_array(F.collect_set("type")), 1, types).alias("types")
    return rows.groupBy("packet_id").agg(kinds, F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


def packet_summary(events: DataFrame) -> DataFrame:
    """packet_id, event_count, times of the first and last event by position (not by time)."""
    return events.groupBy("packet_id").agg(F.count("*").alias("event_count"), F.min_by("t_us", "idx_in_packet").alias("first_event_t_us"), F.max_by("t_us", "idx_in_packet").alias("last_event_t_us"))
