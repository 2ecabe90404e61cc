"""Rejecting events of tiles whose events keep one phase of a frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PhaseConfig, Sensor
from ..functions.scalars import circular_distance, phase_bin, tile_id
from .windows import with_scalar


def with_tile_phase(points: DataFrame, freq_hz: float, cfg: PhaseConfig = PhaseConfig(), sensor: Sensor = Sensor()) -> DataFrame:
    rows = with_scalar(points, __t0=F.min("t"))
    seconds = (F.col("t") - F.col("__t0")).cast("double") * F.lit(1e-6)
    return rows.withColumns({"tile": tile_id(cfg.tile_px, sensor.width), "phase": phase_bin(seconds, freq_hz, cfg.bins)}).drop("__t0")


def tile_counts(points: DataFrame, cfg: PhaseConfig = PhaseConfig(), sensor: Sensor = Sensor()) -> DataFrame:
    """tile, n and whether the tile has enough events to be judged."""
    counts = points.groupBy(tile_id(cfg.tile_px, sensor.width).alias("tile")).agg(F.count("*").alias("n"))
    return counts.withColumn("eligible", F.col("n") >= cfg.min_events)


def tile_phase_strength(points: DataFrame, freq_hz: float, cfg: PhaseConfig = PhaseConfig(), sensor: Sensor = Sensor()) -> DataFrame:
    """tile, n, peak_bin (the first of the fullest) and strength (its share) of eligible tiles."""
    bins = with_tile_phase(points, freq_hz, cfg, sensor).groupBy("tile", "phase").agg(F.count("*").alias("c"))
    peak = F.max(F.struct("c", (-F.col("phase")).alias("p"))).alias("peak")
    tiles = bins.groupBy("tile").agg(F.sum("c").alias("n"), peak).where(F.col("n") >= cfg.min_events)
    return tiles.select("tile", "n", (-F.col("peak.p")).alias("peak_bin"), (F.col("peak.c") / F.col("n")).cast("float").cast("double").alias("strength"))


def phase_filter(points: DataFrame, freq_hz: float, cfg: PhaseConfig = PhaseConfig(), sensor: Sensor = Sensor()) -> DataFrame:
    """points with keep: false near the peak phase of a tile whose strength is over the threshold. A frequency of 0 or less rejects nothing."""
    if freq_hz <= 0:
        return points.withColumn("keep", F.lit(True))
    peaks = tile_phase_strength(points, freq_hz, cfg, sensor).where(F.col("strength") > cfg.strength).select("tile", "peak_bin")
    rows = with_tile_phase(points, freq_hz, cfg, sensor).join(F.broadcast(peaks), "tile", "left")  # a row a tile of the sensor
    near = circular_distance(F.col("phase"), F.col("peak_bin"), cfg.bins) <= cfg.reach
    return rows.withColumn("keep", ~F.coalesce(near, F.lit(False))).select(*points.columns, "keep")


def phase_filter_counts(filtered: DataFrame, freq_hz: float) -> DataFrame:
    """rejected and kept; where the filter does not apply (no rows, no frequency) both are 0 though rows pass."""
    if freq_hz <= 0:
        return filtered.agg(F.lit(0).cast("long").alias("rejected"), F.lit(0).cast("long").alias("kept"))
    return filtered.agg(F.count_if(~F.col("keep")).alias("rejected"), F.count_if("keep").alias("kept"))
