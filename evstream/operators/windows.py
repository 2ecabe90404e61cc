"""Time filters, orders and running positions of events and packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import in_bounds, int_div

PACKETS_PER_BUCKET = 65_536
BUCKETS_PER_BLOCK = 1 << 21


def with_scalar(df: DataFrame, **aggregates) -> DataFrame:
    """df with one-row aggregates of itself as columns; the one row is broadcast."""
    one = df.agg(*(a.alias(name) for name, a in aggregates.items()))
    return df.crossJoin(F.broadcast(one))


def dense_range(one: DataFrame, n: Column, name: str, block: int = 65_536) -> DataFrame:
    """Rows 0 .. n - 1 for each row of one, made block by block in as many tasks as there are blocks."""
    blocks = one.withColumn("__n", n.cast("long")).where("__n > 0").withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), int_div(F.col("__n") - 1, block))))
    ends = F.least(F.col("__n"), (F.col("__block") + 1) * block) - 1
    return blocks.repartition("__block").withColumn(name, F.explode(F.sequence(F.col("__block") * block, ends))).drop("__n", "__block")


def bounds_filter(events: DataFrame, width: int, height: int) -> DataFrame:
    return events.where(in_bounds(width, height))


def time_crop(points: DataFrame, start_s: float | None = None, end_s: float | None = None) -> DataFrame:
    """Rows whose seconds since the first are within start_s and end_s, both inclusive; without bounds all rows."""
    if start_s is None and end_s is None:
        return points
    rel = (F.col("t") - F.col("__t0")) * F.lit(1e-6)
    rows = with_scalar(points, __t0=F.min("t")).where(rel >= float(start_s or 0.0))
    return (rows if end_s is None else rows.where(rel <= float(end_s))).drop("__t0")


def time_rebase(points: DataFrame) -> DataFrame:
    return with_scalar(points, __t0=F.min("t")).withColumn("t", F.col("t") - F.col("__t0")).drop("__t0")


def trailing_window(events: DataFrame, window_ms: float) -> DataFrame:
    """The last window_ms by event time; now is the latest event of all rows given."""
    return with_scalar(events, __now=F.max("t_us")).where(F.col("t_us") >= F.col("__now") - int(window_ms * 1000)).drop("__now")


def channel_bounds(windows_ms: tuple[float, float, float], mode: str) -> list[tuple[int, int, int]]:
    """(channel, oldest, newest) offsets from now in microseconds, closed at both ends."""
    w = [int(x * 1000) for x in windows_ms]
    return [(k, x, 0 if mode == "cumulative" or k == 0 else w[k - 1]) for k, x in enumerate(w)]


def channel_masks(events: DataFrame, windows_ms: tuple[float, float, float], mode: str = "cumulative") -> DataFrame:
    """One row for each event and channel whose window has it; shifted windows share their boundaries."""
    channels = F.array(*(F.struct(F.lit(c).alias("ch"), F.lit(old).alias("old"), F.lit(new).alias("new")) for c, old, new in channel_bounds(windows_ms, mode)))
    rows = with_scalar(events, __now=F.max("t_us"))
    held = F.filter(channels, lambda c: (F.col("t_us") >= F.col("__now") - c["old"]) & (F.col("t_us") <= F.col("__now") - c["new"]))
    return rows.withColumn("ch", F.explode(F.transform(held, lambda c: c["ch"]))).drop("__now")


def tick_windows(events: DataFrame, period_us: int, window_us: int) -> DataFrame:
    """One row for each event and tick whose trailing window has it, with the tick's number.

    Tick k comes k periods after 0; its now is the latest event up to then, and its window reaches back from now. An
    event is offered to the ticks that could have it, and one row a tick says which do.
    """
    up = lambda c: int_div(c + period_us - 1, period_us)
    latest = events.groupBy(up(F.col("t_us")).alias("tick")).agg(F.max("t_us").alias("now"))
    reach = window_us // period_us + 1
    # ticks without an event of their own keep the now before them, for as many ticks as a window spans
    later = latest.withColumn("tick", F.explode(F.sequence(F.col("tick"), F.col("tick") + reach))).groupBy("tick").agg(F.max("now").alias("now"))
    offered = events.withColumn("tick", F.explode(F.sequence(up(F.col("t_us")), up(F.col("t_us")) + 2 * reach)))
    return offered.join(later, "tick").where(F.col("t_us") >= F.col("now") - window_us).drop("now")


def time_sort(events: DataFrame, time: str = "t_us") -> DataFrame:
    """By time; arrival order decides among equals, as in a stable sort."""
    return events.orderBy(time, "ord")


def keep_last_packets(events: DataFrame, k: int) -> DataFrame:
    """Events of the k latest packets: the k ids are found by a top-k, not by a sort of all."""
    last = events.select("packet_id").distinct().orderBy(F.desc("packet_id")).limit(k)
    return events.join(F.broadcast(last), "packet_id", "left_semi")


def evict_packets(events: DataFrame, window_s: float, at_packet: int | None = None) -> DataFrame:
    """Events of the packets a buffer still holds after packet at_packet (the last, if null).

    Packets leave from the head only, while their latest time is before the newest packet's latest time less the
    window. A packet stays once any packet before it stays, which matters where packet times are not monotone.
    """
    packets = events.groupBy("packet_id").agg(F.max("t_us").alias("latest"))
    if at_packet is not None:
        packets = packets.where(F.col("packet_id") <= at_packet)
    cut = packets.agg(F.max_by("latest", "packet_id").alias("newest")).select((F.col("newest") - int(window_s * 1_000_000)).alias("cut"))
    head = packets.crossJoin(F.broadcast(cut)).where("latest >= cut").agg(F.min("packet_id").alias("head"))
    rows = events.crossJoin(F.broadcast(head)).where(F.col("packet_id") >= F.col("head"))
    return (rows if at_packet is None else rows.where(F.col("packet_id") <= at_packet)).drop("head")


def running_offsets(packets: DataFrame, order: str, value: str) -> DataFrame:
    """packets with start_event_idx, end_event_idx and packet_idx: running sums and counts in the order of packets.

    Sums run inside buckets of PACKETS_PER_BUCKET ids, whose totals run inside blocks of BUCKETS_PER_BLOCK buckets, whose totals
    run in one place: a row for 2^37 ids, or for 32 capture files. No other window meets more than a block's rows.
    """
    rows = packets.withColumn("__bucket", int_div(F.col(order), PACKETS_PER_BUCKET))
    totals = rows.groupBy("__bucket").agg(F.sum(value).alias("__sum"), F.count("*").alias("__n"))
    totals = totals.withColumn("__block", int_div(F.col("__bucket"), BUCKETS_PER_BLOCK))
    blocks = totals.groupBy("__block").agg(F.sum("__sum").alias("__sum"), F.sum("__n").alias("__n"))

    def before(df: DataFrame, key: str, *within: str) -> DataFrame:
        """The sums of what comes before each key."""
        window = Window.partitionBy(*within).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        return df.select(*within, key, *(F.coalesce(F.sum(c).over(window), F.lit(0)).alias(f"{c}_{key}") for c in ("__sum", "__n")))

    shift = before(totals, "__bucket", "__block").join(before(blocks, "__block"), "__block")
    added = lambda c: (F.col(f"{c}___bucket") + F.col(f"{c}___block")).alias(f"{c}_before")
    shift = shift.select("__bucket", added("__sum"), added("__n"))
    inside = Window.partitionBy("__bucket").orderBy(order)
    rows = rows.withColumns({"__end": F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)), "__at": F.row_number().over(inside) - 1})
    rows = rows.join(shift, "__bucket")  # dealt by bucket already
    end = F.col("__sum_before") + F.col("__end")
    return rows.withColumns({"start_event_idx": end - F.col(value), "end_event_idx": end, "packet_idx": F.col("__n_before") + F.col("__at")}).drop("__bucket", "__sum_before", "__n_before", "__end", "__at")
