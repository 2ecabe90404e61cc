"""The offline pipeline: from a point table to the filtered film and its statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MotionConfig, Sensor
from ..operators.frames import debug_classes, frame_series
from ..operators.motion import filter_summary, motion_filter
from ..operators.windows import bounds_filter, time_crop, time_rebase


@dataclass
class Offline:
    filtered: DataFrame  # all rows in bounds, with neighbors, coherence and keep
    summary: DataFrame
    classes: DataFrame
    frames: DataFrame


def offline(points: DataFrame, cfg: MotionConfig = MotionConfig(), sensor: Sensor = Sensor(), start_s: float | None = None, end_s: float | None = None, fps: float = 30.0) -> Offline:
    """Bounds, crop, re-base, motion filter; then counts, touched pixels by fate and the two-sided frame series. All lazy; empty input gives empty tables.

    Sorting by time is left out: no step depends on the rows' order.
    """
    rows = time_rebase(time_crop(bounds_filter(points, sensor.width, sensor.height), start_s, end_s))
    filtered = motion_filter(rows, cfg)
    return Offline(filtered, filter_summary(filtered), debug_classes(filtered, sensor), frame_series(filtered, fps, sensor))


def rejected(filtered: DataFrame) -> DataFrame:
    """The complement of the kept rows."""
    return filtered.where(~F.col("keep"))
