"""Frames as sparse relations: touched pixels only, all others at the default (128, or 0 for counts)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FrameConfig, PreviewConfig, Sensor
from ..functions.scalars import clamp, int_div, polarity, quantize
from .windows import bounds_filter, channel_masks, dense_range, trailing_window

GREY = 128
#: Small Gaussian kernels, by size.
GAUSSIAN = {1: [1.0], 3: [0.25, 0.5, 0.25], 5: [0.0625, 0.25, 0.375, 0.25, 0.0625], 7: [0.03125, 0.109375, 0.21875, 0.28125, 0.21875, 0.109375, 0.03125]}


def signed_accumulate(events: DataFrame, step: float = 1.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """acc by pixel: a step up for type 1, a step down for any other."""
    return events.groupBy(*keys, "y", "x").agg(F.sum(polarity(step)).alias("acc"))


def _normalised(acc: DataFrame, contrast: float, keys: tuple[str, ...] = ()) -> DataFrame:
    most = acc.groupBy(*keys).agg(F.max(F.abs("acc")).alias("__m"))
    rows = acc.join(F.broadcast(most), list(keys)) if keys else acc.crossJoin(F.broadcast(most))
    value = F.when(F.col("__m") > 0, F.col("acc") / F.col("__m")).otherwise(F.col("acc"))
    return rows.select(*keys, "y", "x", quantize(128.0 + value * float(contrast) * 127.0).alias("level"))


def mono_frame(events: DataFrame, cfg: FrameConfig = FrameConfig(), sensor: Sensor = Sensor()) -> DataFrame:
    """y, x, level of the last window, scaled by the frame's largest magnitude."""
    rows = bounds_filter(trailing_window(events, cfg.window_ms), sensor.width, sensor.height)
    return _normalised(signed_accumulate(rows, cfg.step), cfg.contrast)


def three_channel_frame(events: DataFrame, cfg: FrameConfig = FrameConfig(), sensor: Sensor = Sensor()) -> DataFrame:
    """ch, y, x, level: one frame a time window, each scaled by its own largest magnitude."""
    rows = bounds_filter(channel_masks(events, cfg.windows_ms, cfg.mode), sensor.width, sensor.height)
    return _normalised(signed_accumulate(rows, cfg.step, ("ch",)), cfg.contrast, ("ch",))


def decay_frame(events: DataFrame, cfg: PreviewConfig = PreviewConfig(), sensor: Sensor = Sensor()) -> DataFrame:
    """y, x, acc, level after the last packet, a tick a packet: each tick fades what there is and adds the whole buffer.

    A packet is in the buffers of max_packets ticks, so its weight is a geometric series in closed form.
    """
    last = events.agg(F.max("packet_id").alias("__last"))
    rows = bounds_filter(events, sensor.width, sensor.height).crossJoin(F.broadcast(last))
    age = F.col("__last") - F.col("packet_id")
    gone = F.greatest(F.lit(0), age - (cfg.max_packets - 1))  # ticks since it left the buffer
    d = float(cfg.decay)
    weight = (age - gone + 1).cast("double") if d == 1.0 else (F.pow(F.lit(d), gone) - F.pow(F.lit(d), age + 1)) / (1.0 - d)
    acc = rows.groupBy("y", "x").agg(F.sum(polarity(cfg.step) * weight).alias("acc"))
    return acc.select("y", "x", "acc", quantize(128.0 + F.col("acc") * float(cfg.contrast)).alias("level"))


def pixel_heatmap(events: DataFrame) -> DataFrame:
    counts = events.groupBy("y", "x").agg(F.count("*").alias("n"))
    return counts.withColumn("log_n", F.log1p("n"))


def frame_counts(points: DataFrame, sensor: Sensor = Sensor(), keys: tuple[str, ...] = ()) -> DataFrame:
    """n by pixel, coordinates outside the sensor moved to its edge."""
    x, y = clamp(F.col("x"), 0, sensor.width - 1), clamp(F.col("y"), 0, sensor.height - 1)
    return points.groupBy(*keys, y.alias("y"), x.alias("x")).agg(F.count("*").alias("n"))


def percentile_render(counts: DataFrame, sensor: Sensor = Sensor(), keys: tuple[str, ...] = (), clip: bool = False) -> DataFrame:
    """level of each touched pixel: log counts scaled by their 99th percentile over all pixels of the frame.

    Levels over 255 wrap, unless clip; where the percentile is 0 the level is the log count cut to an integer.
    """
    rows = counts.withColumn("v", F.log1p("n"))
    # the percentile over width x height values of which most are 0, without making them: one row stands for all zeros
    zeros = rows.groupBy(*keys).agg((F.lit(sensor.width * sensor.height) - F.count("*")).alias("w")).select(*keys, F.lit(0.0).alias("v"), "w")
    both = rows.select(*keys, "v", F.lit(1).cast("long").alias("w")).unionByName(zeros.select(*keys, "v", F.col("w").cast("long"))).where("w > 0")
    p99 = both.groupBy(*keys).agg(F.percentile("v", F.lit(0.99), F.col("w")).alias("p99"))
    rows = rows.join(p99, list(keys)) if keys else rows.crossJoin(F.broadcast(p99))
    scaled = F.floor(F.when(F.col("p99") > 0, F.col("v") / F.col("p99") * 255.0).otherwise(F.col("v")))
    level = F.least(scaled, F.lit(255)) if clip else F.pmod(scaled, F.lit(256))
    return rows.select(*keys, "y", "x", "n", level.cast("smallint").alias("level"))


def debug_classes(points: DataFrame, sensor: Sensor = Sensor()) -> DataFrame:
    """y, x, kept of touched pixels: kept rows are drawn over rejected ones."""
    x, y = clamp(F.col("x"), 0, sensor.width - 1), clamp(F.col("y"), 0, sensor.height - 1)
    return points.groupBy(y.alias("y"), x.alias("x")).agg(F.max("keep").alias("kept"))


def upscale(frame: DataFrame, factor: int) -> DataFrame:
    """Nearest-neighbour enlargement."""
    if factor <= 1:
        return frame
    steps = F.array(*map(F.lit, range(factor)))
    rows = frame.withColumn("__dy", F.explode(steps)).withColumn("__dx", F.explode(steps))
    return rows.withColumns({"y": F.col("y") * factor + F.col("__dy"), "x": F.col("x") * factor + F.col("__dx")}).drop("__dy", "__dx")


def _spread(frame: DataFrame, axis: str, extent: int, weights: list[float], anchor: int, value: str, others: list[str]) -> DataFrame:
    """One axis of a blur of deviations: each pixel adds to the outputs whose window has it, borders reflected without the edge."""
    k = len(weights)
    s = F.col(axis)
    seen_as = F.array_distinct(F.array(s, -s, 2 * (extent - 1) - s))  # places at which the border shows the pixel
    taps = F.array(*(F.struct(F.lit(i - anchor).alias("d"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)))
    rows = frame.withColumn("__u", F.explode(seen_as)).where((F.col("__u") >= -k) & (F.col("__u") < extent + k)).withColumn("__t", F.explode(taps))
    rows = rows.withColumn("__o", F.col("__u") - F.col("__t.d")).where((F.col("__o") >= 0) & (F.col("__o") < extent))
    return rows.groupBy(*others, F.col("__o").cast("int").alias(axis)).agg(F.sum(F.col(value) * F.col("__t.w")).alias(value))


def _blur(frame: DataFrame, weights: list[float], anchor: int, sensor: Sensor, keys: tuple[str, ...]) -> DataFrame:
    rows = frame.select(*keys, "y", "x", (F.col("level").cast("double") - GREY).alias("v"))
    rows = _spread(rows, "x", sensor.width, weights, anchor, "v", [*keys, "y"])
    rows = _spread(rows, "y", sensor.height, weights, anchor, "v", [*keys, "x"])
    return rows.select(*keys, "y", "x", F.floor(F.round(F.col("v"), 9) + GREY + 0.5).cast("smallint").alias("level"))


def box_blur(frame: DataFrame, k: int = 2, sensor: Sensor = Sensor(), keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean of k x k pixels around (an even window reaches one further back), halves rounded up; k of 1 or less changes nothing."""
    return frame if k <= 1 else _blur(frame, [1.0 / k] * k, k // 2, sensor, keys)


def gaussian_weights(k: int) -> list[float]:
    if k in GAUSSIAN:
        return GAUSSIAN[k]
    sigma = 0.3 * ((k - 1) * 0.5 - 1) + 0.8
    raw = [math.exp(-((i - (k - 1) / 2) ** 2) / (2 * sigma * sigma)) for i in range(k)]
    return [w / sum(raw) for w in raw]


def gaussian_blur(frame: DataFrame, k: int = 3, sensor: Sensor = Sensor(), keys: tuple[str, ...] = ()) -> DataFrame:
    """Separable Gaussian of size k (made odd), its width from its size; k under 2 changes nothing."""
    if k < 2:
        return frame
    k += 1 - k % 2
    return _blur(frame, gaussian_weights(k), k // 2, sensor, keys)


def frame_series(points: DataFrame, fps: float = 30.0, sensor: Sensor = Sensor()) -> DataFrame:
    """side (raw, filtered), frame_idx, y, x, n, level of a two-sided film; points have t and keep.

    Both sides run by the raw rows' clock. Frames last int(1e6 / fps) microseconds, so the tail may fall off.
    """
    length = int(1e6 / fps)
    clock = points.agg(F.min("t").alias("__t0"), F.max("t").alias("__t1"))
    frames = F.greatest(F.lit(1), F.ceil((F.col("__t1") - F.col("__t0")) * F.lit(1e-6) * float(fps)))
    rows = points.crossJoin(F.broadcast(clock)).where("__t1 > __t0")
    rows = rows.withColumn("frame_idx", int_div(F.col("t") - F.col("__t0"), length)).where(F.col("frame_idx") < frames)
    rows = rows.withColumn("side", F.explode(F.when(F.col("keep"), F.array(F.lit("raw"), F.lit("filtered"))).otherwise(F.array(F.lit("raw")))))
    keys = ("side", "frame_idx")
    return percentile_render(frame_counts(rows, sensor, keys), sensor, keys)


def frame_spine(points: DataFrame, fps: float = 30.0) -> DataFrame:
    """side and frame_idx of all frames of frame_series, those without a touched pixel too."""
    clock = points.agg(F.min("t").alias("t0"), F.max("t").alias("t1")).where("t1 > t0")
    n = F.greatest(F.lit(1), F.ceil((F.col("t1") - F.col("t0")) * F.lit(1e-6) * float(fps)))
    return dense_range(clock, n, "frame_idx").select("frame_idx", F.explode(F.array(F.lit("raw"), F.lit("filtered"))).alias("side"))


def latest_frame_header(frame: DataFrame, stamp_us: int, frame_id: str = "camera", encoding: str = "mono8") -> DataFrame:
    """The header that goes out with a frame, also with one that has no touched pixel."""
    return frame.groupBy().agg(F.count("*").alias("touched")).select(F.lit(stamp_us).alias("stamp_us"), F.lit(frame_id).alias("frame_id"), F.lit(encoding).alias("encoding"), "touched")
