"""Count signals: events by time bin, dense."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FlickerConfig
from ..functions.scalars import int_div
from .windows import dense_range


def count_signal(events: DataFrame, cfg: FlickerConfig = FlickerConfig(), keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, bin, c over [end - bins, end): the latest event itself is never counted. Each key has its own end."""
    n = cfg.bins
    ends = events.groupBy(*keys).agg(F.max("t_us").alias("__end")).where("__end is not null")
    rows = events.join(F.broadcast(ends), list(keys)) if keys else events.crossJoin(F.broadcast(ends))
    since = F.col("t_us") - (F.col("__end") - n * cfg.bin_us)
    rows = rows.where(since >= 0).withColumn("bin", int_div(since, cfg.bin_us)).where(F.col("bin") < n)
    counts = rows.groupBy(*keys, "bin").agg(F.count("*").cast("double").alias("c"))
    spine = ends.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("bin"))
    return spine.join(counts, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("c", F.lit(0.0)).alias("c"))


def burst_clip(signal: DataFrame, k: float = 2.0, least: float = 30.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """signal with c cut at the threshold: mean and k population standard deviations over it, or least if that is more."""
    stats = signal.groupBy(*keys).agg(F.greatest(F.avg("c") + float(k) * F.stddev_pop("c"), F.lit(float(least))).alias("threshold"))
    rows = signal.join(F.broadcast(stats), list(keys)) if keys else signal.crossJoin(F.broadcast(stats))
    return rows.withColumn("c", F.least("c", "threshold"))


def rate_histogram(points: DataFrame, bin_ms: float = 1.0) -> DataFrame:
    """bin, rate (events a second) over bins whose edges are multiples of a floating-point step.

    There is one bin more than the duration needs. Without rows, or where all times are equal, there is no bin.
    """
    bin_s = bin_ms * 1e-3
    clock = points.agg(F.min("t").alias("__t0"), F.max("t").alias("__t1")).where("__t1 > __t0")
    n = (F.ceil((F.col("__t1") - F.col("__t0")).cast("double") * F.lit(1e-6) / F.lit(bin_s)) + 1).cast("long")
    clock = clock.withColumn("__n", n).withColumn("__step", F.col("__n") * F.lit(bin_s) / F.col("__n"))
    s = (F.col("t") - F.col("__t0")).cast("double") * F.lit(1e-6)
    k = F.floor(s / F.col("__step"))
    k = k - (s < k * F.col("__step")).cast("int") + (s >= (k + 1) * F.col("__step")).cast("int")
    counts = points.crossJoin(F.broadcast(clock)).groupBy(k.cast("long").alias("bin")).agg(F.count("*").alias("n"))
    spine = dense_range(clock.select("__n"), F.col("__n"), "bin")
    return spine.join(counts, "bin", "left").select("bin", (F.coalesce("n", F.lit(0)) / F.lit(bin_s)).alias("rate"))
