"""The two tables of a raw recording."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import packet_summary
from .windows import running_offsets


def recording_packets(packets: DataFrame, first_packet: int = 0, first_event: int = 0) -> DataFrame:
    """Packet rows from summaries (packet_id, event_count, first and last time; arrival times if known), counted on from what is recorded."""
    rows = running_offsets(packets, "packet_id", "event_count")
    time = lambda c: F.when(F.col("event_count") > 0, F.col(c)).otherwise(F.lit(-1)).cast("long").alias(c)
    known = [F.col(c).cast("long").alias(c) if c in packets.columns else F.lit(None).cast("long").alias(c) for c in ("ros_t_ns", "monotonic_t_ns")]
    return rows.select(
        "packet_id", (F.col("packet_idx") + first_packet).alias("packet_idx"), *known, (F.col("start_event_idx") + first_event).alias("start_event_idx"),
        (F.col("end_event_idx") + first_event).alias("end_event_idx"), "event_count", time("first_event_t_us"), time("last_event_t_us"),
    )


def recording_events(events: DataFrame, packets: DataFrame) -> DataFrame:
    """Event rows: the type in eight bits, coordinates as they came, the packet's number in the recording and the event's place."""
    at = packets.select("packet_id", F.col("packet_idx"), "start_event_idx")
    rows = events.join(at, "packet_id")
    return rows.select((F.col("start_event_idx") + F.col("idx_in_packet")).alias("event_idx"), F.pmod("type", F.lit(256)).cast("smallint").alias("type"), "x", "y", "t_us", F.col("packet_idx").alias("packet_id"))


def record(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, packets) of a recording made of all rows."""
    packets = recording_packets(packet_summary(events))
    return recording_events(events, packets), packets.drop("packet_id")
