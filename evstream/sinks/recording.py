"""A raw recording on disk: an events table, a packets table and a row of metadata."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from ..config import RecordingConfig
from ..operators.recording import record


def recording_path(cfg: RecordingConfig, now: float | None = None) -> str:
    """The configured folder, or one named by the time."""
    return cfg.path.strip() or time.strftime("raw_events_%Y%m%d_%H%M%S", time.localtime(now))


def open_recording(spark: SparkSession, cfg: RecordingConfig, path: str | None = None) -> str:
    """Write the metadata row; a recording that exists is an error. Parent folders are made."""
    path = path or recording_path(cfg)
    notes = ("first and last event times are by position in the packet", "event times are microseconds of the device's clock")
    row = (cfg.source, cfg.sensor.width, cfg.sensor.height, "type,sec,ms,us,x,y", time.time(), notes[1], notes[0])
    schema = "source string, width int, height int, event_column_order string, created_wall_time double, timestamp_note string, packet_first_last_timestamp_note string"
    spark.createDataFrame([row], schema).coalesce(1).write.mode("errorifexists").parquet(f"{path}/metadata")
    return path


def append_recording(events: DataFrame, packets: DataFrame, path: str, cfg: RecordingConfig) -> None:
    for name, df in (("events", events), ("packets", packets)):
        df.write.mode("append").options(**cfg.parquet).parquet(f"{path}/{name}")


def write_recording(events: DataFrame, cfg: RecordingConfig, path: str | None = None) -> str:
    """Record event rows (see sources.packets.explode_packets) in one go."""
    path = open_recording(events.sparkSession, cfg, path)
    append_recording(*record(events), path, cfg)
    return path


def read_recording(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("events", "packets", "metadata"))
