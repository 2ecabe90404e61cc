"""Registered queries over the test tables and the SQL that states their rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import FlickerConfig, FrameConfig, MotionConfig, PhaseConfig, PreviewConfig, RecordingConfig
from .operators import frames, motion, phase, recording, signal, spectral, stats, windows
from .oracles import ORACLES
from .functions.scalars import circular_distance, clamp, event_timestamp, grid_cell, phase_bin, quantize, register_functions, tile_id
from .plans.pipelines import offline, rejected
from .scratch import scratch_path
from .sinks.film import read_film, write_film
from .sinks.frames import frame_message
from .sinks.recording import read_recording, write_recording
from .sources.adapter import camera_events, points
from .sources.packets import HEADER, MAGIC, capture_files, explode_packets, group_packets, read_packets, write_packets
from .sources.xyt import read_points
from .streaming import ticks
from .streaming.buffer import buffered, packet_heads
from .streaming.preview import decaying_preview, packet_deltas, preview_frame
from .streaming.recorder import Recorder
from .streaming.replay import replay, replayed_packets, run_to_end

W = H = 320
FLICKER = FlickerConfig()
STRICT = MotionConfig(min_coherence=0.9)
SHIFTED = FrameConfig(mode="shifted")
LOW_STRENGTH = PhaseConfig(strength=0.05)

__all__ = ["ORACLES", "QUERIES"]

Query = Callable[[DataFrame], DataFrame]


def r6(column: str, name: str | None = None):
    return F.round(F.col(column), 6).alias(name or column)


def inside(ev: DataFrame) -> DataFrame:
    return windows.bounds_filter(ev, W, H)


def pts(ev: DataFrame) -> DataFrame:
    return points(inside(ev))


def scalar_functions(ev: DataFrame) -> DataFrame:
    """Phase bin, its distance to bin 3, and the log and quantised forms of a value of each event."""
    seconds = F.col("t_us").cast("double") * F.lit(1e-6)
    rows = ev.withColumn("phase", phase_bin(seconds, 240.0))
    return rows.select("ord", "phase", circular_distance(F.col("phase"), F.lit(3)).alias("distance"), F.round(F.log1p("x"), 6).alias("log_x"), quantize(F.col("x") * 1.5 - 20).alias("level"))


def throughput(ev: DataFrame) -> DataFrame:
    totals = stats.throughput(stats.packet_summary(ev), 2.0)
    return totals.select("packets", "events", "payload_bytes", "protocol_bytes", *(r6(c) for c in ("packets_per_s", "events_per_s", "payload_mb_per_s", "protocol_mb_per_s")))


def power_band(ev: DataFrame) -> DataFrame:
    n = FLICKER.bins
    power = spectral.fft_power(signal.count_signal(inside(ev), FLICKER), n, FLICKER.bin_us, *spectral.band_bins(n, FLICKER.bin_us, 40.0, 300.0))
    return power.select("k", r6("freq_hz"), F.round(F.log1p("power"), 6).alias("log_power"))


def top_peaks(ev: DataFrame) -> DataFrame:
    n = FLICKER.bins
    power = spectral.fft_power(signal.count_signal(inside(ev), FLICKER), n, FLICKER.bin_us, *spectral.band_bins(n, FLICKER.bin_us, 40.0, 300.0))
    return spectral.top_peaks(power, 40.0, 300.0).select(r6("freq_hz"), F.round(F.log1p("power"), 6).alias("log_power"), r6("rel"))


def clipped(ev: DataFrame, least: float) -> DataFrame:
    cfg = FlickerConfig(burst_min=least)
    return spectral.flicker_ratio(inside(ev), cfg, clipped=True).select(r6("ratio"), r6("threshold"))


def motion_rows(ev: DataFrame, cfg: MotionConfig) -> DataFrame:
    return motion.motion_filter(pts(ev), cfg)


def summary(filtered: DataFrame) -> DataFrame:
    return motion.filter_summary(filtered).select("raw", "kept", "rejected", r6("kept_pct"), r6("rejected_pct"), r6("mean_neighbors"), r6("median_neighbors"))


_BY_EVENTS: dict[str, Query] = {
    "event_timestamp": lambda ev: ev.select("ord", event_timestamp().alias("t")),
    "bounds_filter": lambda ev: inside(ev).select("ord", "x", "y"),
    "coord_clamp": lambda ev: ev.select("ord", clamp(F.col("x"), 0, W - 1).alias("x"), clamp(F.col("y"), 0, 150).alias("y")),
    "scalar_functions": scalar_functions,
    "time_crop": lambda ev: windows.time_crop(pts(ev), 0.5, 1.25).select("ord", "t"),
    "time_rebase": lambda ev: windows.time_rebase(pts(ev)).select("ord", "t"),
    "trailing_window": lambda ev: windows.trailing_window(ev, 100.0).select("ord", "t_us"),
    "channel_masks": lambda ev: windows.channel_masks(ev, (50.0, 250.0, 1000.0)).select("ord", "ch"),
    "channel_masks_shifted": lambda ev: windows.channel_masks(ev, (50.0, 250.0, 1000.0), "shifted").select("ord", "ch"),
    "tick_windows": lambda ev: windows.tick_windows(ev, 33_333, 100_000).groupBy("tick").agg(F.count("*").alias("n"), F.min("t_us").alias("oldest"), F.max("t_us").alias("newest")),
    "tile_assign": lambda ev: inside(ev).select("ord", tile_id(16, W).alias("tile")),
    "grid_assign": lambda ev: inside(ev).select("ord", grid_cell("x", W, 3).alias("gx"), grid_cell("y", H, 3).alias("gy")),
    "signed_accumulate": lambda ev: frames.signed_accumulate(inside(ev)),
    "mono_frame": frames.mono_frame,
    "three_channel_cumulative": frames.three_channel_frame,
    "three_channel_shifted": lambda ev: frames.three_channel_frame(ev, SHIFTED.checked()),
    "decay_frame": lambda ev: frames.decay_frame(ev, PreviewConfig()).select("y", "x", r6("acc"), "level"),
    "pixel_heatmap": lambda ev: frames.pixel_heatmap(inside(ev)).select("y", "x", "n", r6("log_n")),
    "frame_counts": lambda ev: frames.frame_counts(points(ev)),
    "count_signal": lambda ev: signal.count_signal(inside(ev), FLICKER),
    "rate_histogram": lambda ev: signal.rate_histogram(pts(ev)).select("bin", r6("rate")),
    "burst_clip": lambda ev: signal.burst_clip(signal.count_signal(inside(ev), FLICKER), 2.0, 0.0).select("bin", r6("c"), r6("threshold")),
    "fft_power_band": power_band,
    "fft_magnitude": lambda ev: spectral.fft_magnitude(pts(ev)).select("k", r6("freq_hz"), F.round(F.log1p("magnitude"), 6).alias("log_magnitude")),
    "flicker_ratio": lambda ev: spectral.flicker_ratio(inside(ev), FLICKER).select(r6("ratio")),
    "flicker_ratio_clipped": lambda ev: clipped(ev, 30.0),
    "flicker_ratio_clipped_low": lambda ev: clipped(ev, 0.0),
    "grid_flicker": lambda ev: spectral.grid_flicker(inside(ev), FLICKER).select("gy", "gx", r6("ratio")),
    "dominant_frequency": lambda ev: spectral.dominant_frequency(pts(ev)).select(r6("freq_hz")),
    "top_peaks": top_peaks,
    "tile_counts": lambda ev: phase.tile_counts(pts(ev)),
    "tile_phase_strength": lambda ev: phase.tile_phase_strength(pts(ev), 240.0).select("tile", "n", "peak_bin", r6("strength")),
    "phase_filter": lambda ev: phase.phase_filter(pts(ev), 240.0).select("ord", "keep"),
    "phase_filter_low": lambda ev: phase.phase_filter(pts(ev), 240.0, LOW_STRENGTH).select("ord", "keep"),
    "percentile_render": lambda ev: frames.percentile_render(frames.frame_counts(pts(ev))),
    "throughput": throughput,
    "window_stats": lambda ev: stats.window_stats(inside(ev), FLICKER.window_s, W * H).select("events", r6("events_per_s"), "active_px", r6("active_share")),
    "packet_probe": lambda ev: stats.packet_probe(ev).withColumn("types", F.array_join("types", ",")),
    "recording_events": lambda ev: recording.record(ev)[0],
    "recording_packets": lambda ev: recording.record(ev)[1].drop("ros_t_ns", "monotonic_t_ns"),
    "motion_neighbors": lambda ev: motion_rows(ev, MotionConfig()).select("ord", "neighbors", r6("coherence")),
    "motion_filter": lambda ev: motion_rows(ev, MotionConfig()).where("keep").select("ord", "x", "y", "t", "neighbors"),
    "motion_filter_strict": lambda ev: motion_rows(ev, STRICT).where("keep").select("ord", "x", "y", "t", "neighbors"),
    "motion_support_only": lambda ev: motion_rows(ev, MotionConfig(support_only=True)).where("keep").select("ord", "x", "y", "t", "neighbors"),
    "rejected_events": lambda ev: rejected(motion_rows(ev, STRICT)).select("ord", "neighbors"),
    "filter_summary": lambda ev: summary(motion_rows(ev, STRICT)),
    "debug_classes": lambda ev: frames.debug_classes(motion_rows(ev, STRICT)),
    "time_sort": lambda ev: windows.time_sort(ev).select("ord", "t_us"),
    "keep_last_packets": lambda ev: windows.keep_last_packets(ev, 10).select("ord", "packet_id"),
    "packet_eviction": lambda ev: windows.evict_packets(ev, 0.5, 100).select("ord", "packet_id"),
    "packet_eviction_all": lambda ev: windows.evict_packets(ev, 0.5).select("ord", "packet_id"),
    "frame_message": lambda ev: _message(frames.mono_frame(ev), "mono8"),
    "frame_message_three_channel": lambda ev: _message(frames.three_channel_frame(ev), "bgr8", "ch"),
    "frame_series": lambda ev: frames.frame_series(motion_rows(ev, STRICT)),
    "offline_pipeline": lambda ev: summary(offline(points(ev), STRICT, start_s=0.5, end_s=2.5).filtered),
    "upscale": lambda ev: frames.upscale(frames.mono_frame(ev), 2),
    "box_blur": lambda ev: frames.box_blur(frames.mono_frame(ev), 2),
    "gaussian_blur": lambda ev: frames.gaussian_blur(frames.mono_frame(ev), 3),
}


def _capture(spark: SparkSession, sf_dir: str, noise: str = "EVT noise", events: DataFrame | None = None) -> str:
    """The tables' events as capture files, with noise between the packets."""
    path = scratch_path(spark, "capture")
    events = camera_events(spark, sf_dir) if events is None else events
    write_packets(group_packets(events).repartitionByRange("packet_id").sortWithinPartitions("packet_id"), path, noise=noise)
    return path


def capture_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables' events, written as capture files and read back through the packet source."""
    return explode_packets(read_packets(spark, _capture(spark, sf_dir)))


def capture_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As capture_recording_events, from a capture that is read in 16 ranges a file, whose borders fall anywhere."""
    path = _capture(spark, sf_dir)
    split = max(64, max(size for _, size in capture_files(path)) // 16)
    return recording.record(explode_packets(read_packets(spark, path, split_bytes=split)))[0]


def capture_corrupt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As capture_recording_events, from a capture with a header before every packet whose two numbers disagree."""
    corrupt = (MAGIC + HEADER.pack(1, 13)).decode()
    return recording.record(explode_packets(read_packets(spark, _capture(spark, sf_dir, corrupt))))[0]


def recording_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As recording_events, from a recording's files."""
    path = write_recording(camera_events(spark, sf_dir), RecordingConfig(path=scratch_path(spark, "recording")))
    return read_recording(spark, path)[0]


def point_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points as tab-separated text, with comments, read back."""
    path = scratch_path(spark, "points")
    pts(camera_events(spark, sf_dir)).select(F.concat_ws("\t", "x", "y", F.concat("t", F.lit(" # a point")))).write.text(path)
    return read_points(spark, path).drop("ord")


def _message(frame: DataFrame, encoding: str, *channel: str) -> DataFrame:
    row = frame_message(frame, 123_456, encoding=encoding)
    head = ("stamp_us", "frame_id", "encoding", "height", "width")
    return row.select(*head, F.explode("pixels").alias("p")).select(*head, *(f"p.{c}" for c in (*channel, "y", "x", "level")))


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar functions called by name in SQL text."""
    register_functions(spark)
    return camera_events(spark, sf_dir).selectExpr("ord", "ev_timestamp(sec, ms, us) AS t", "ev_polarity(type, 0.75D) AS delta")


def film_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two-sided film of frame_series written as image files and read back: lit pixels and the sum of their levels, of frames that have any."""
    path, rows = scratch_path(spark, "film"), motion_rows(camera_events(spark, sf_dir), STRICT)
    write_film(frames.frame_series(rows), frames.frame_spine(rows), path)
    return read_film(spark, path).groupBy("side", "frame_idx").agg(F.count("*").alias("lit"), F.sum("level").alias("total"))


def stream_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As recording_events, recorded micro-batch by micro-batch from a capture that runs as a stream."""
    path = scratch_path(spark, "recorded")
    recorder = Recorder(spark, path, RecordingConfig())
    run_to_end(replayed_packets(spark, _capture(spark, sf_dir)), recorder.write)
    return spark.read.parquet(f"{path}/events").drop("batch")


def stream_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As decay_frame, from the pixels' states after a stream's last packet."""
    events = explode_packets(replayed_packets(spark, _capture(spark, sf_dir)))
    pixels = replay(decaying_preview(packet_deltas(events)), "update")
    return preview_frame(pixels).select("y", "x", r6("acc"), "level")


def _buffer(spark: SparkSession, sf_dir: str, history_us: int, by: str) -> DataFrame:
    """What a buffer holds after the last packet of a stream; a packet arrives at the time of its latest event."""
    heads = packet_heads(replayed_packets(spark, _capture(spark, sf_dir))).withColumn("arrival_us", F.col("latest"))
    states = replay(buffered(heads, history_us, by=by), "update")
    last = F.max_by(F.struct("packets", "events", "oldest_packet", "newest_packet", "latest"), "tick").alias("s")
    return states.groupBy("sensor").agg(last).select("sensor", "s.*")


def stream_tick_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As tick_windows, for the ticks that the stream's clock, a second behind its latest event, has passed.

    The capture has packets in the order of half seconds of their events, so that none comes late where the table's times go back.
    """
    packet = F.struct(F.floor(F.col("t_us") / 500_000).alias("half"), "packet_id")
    path = _capture(spark, sf_dir, events=camera_events(spark, sf_dir).withColumn("packet_id", packet))
    events = explode_packets(replayed_packets(spark, path)).select(F.lit("camera").alias("sensor"), "ord", "t_us")
    rows = replay(ticks.tick_windows(events, 33_333, 100_000))
    return rows.groupBy("tick").agg(F.count("*").alias("n"), F.min("t_us").alias("oldest"), F.max("t_us").alias("newest"))


def _over_capture(query: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(capture_events(spark, sf_dir))


#: Over events that went through capture files: the packet source's numbers are others than the tables', what they count is not.
_BY_CAPTURE: dict[str, Query] = {
    "capture_recording_events": lambda ev: recording.record(ev)[0],
    "capture_recording_packets": lambda ev: recording.record(ev)[1].drop("ros_t_ns", "monotonic_t_ns"),
    "capture_heatmap": lambda ev: frames.pixel_heatmap(inside(ev)).select("y", "x", "n", r6("log_n")),
    "capture_throughput": throughput,
}


#: Over files that are written first, and captures that run as streams to their end.
_THROUGH_FILES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "capture_ranges": capture_ranges,
    "capture_corrupt": capture_corrupt,
    "recording_written": recording_written,
    "point_file": point_file,
    "sql_functions": sql_functions,
    "film_files": film_files,
    "stream_recording": stream_recording,
    "stream_preview": stream_preview,
    "stream_arrival_buffer": lambda spark, sf_dir: _buffer(spark, sf_dir, 500_000, "arrival"),
    "stream_event_buffer": lambda spark, sf_dir: _buffer(spark, sf_dir, 500_000, "event"),
    "stream_tick_windows": stream_tick_windows,
}


def _over_tables(query: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(camera_events(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _over_tables(query) for name, query in _BY_EVENTS.items()} | {name: _over_capture(query) for name, query in _BY_CAPTURE.items()} | _THROUGH_FILES
