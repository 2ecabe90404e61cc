"""The motion filter: neighbours in space and time by ranks in sorted times, support counts and coherence.

An event's neighbours are the earlier ones within a radius and a time window that no speed limit rules out. At one
pixel beside it they are the events between two times, so their number is the difference of two ranks among that
pixel's sorted times; no pair is ever made, and an event costs two binary searches for each pixel of the radius however
crowded the pixels are.

Equal events (x, y and t) have equal neighbours, so they count as one row with a number. Rows are sent to the cells
whose events may look at them: cells are CELL radii wide and CELL windows long, which makes 2.8 copies on average. A
cell holds at most one row for each of its pixels and microseconds, and cells are worked through in blocks of
BLOCK_ROWS rows or one cell, so no hot pixel makes a task larger than that.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MotionConfig

CELL = 4  # cells in radii, time buckets in windows
BLOCK_ROWS = 1 << 17
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def offsets(cfg: MotionConfig) -> list[tuple[int, int, int]]:
    """dx, dy and the least time apart in microseconds at which an event there is a neighbour, for the pixels that can hold one.

    Speeds are compared without a root: a neighbour is too fast if (dx^2 + dy^2) 10^6 > max_speed^2 dt^2.
    """
    r, limit = cfg.radius_px, float(cfg.max_speed) * float(cfg.max_speed)

    def least(squares: int) -> int | None:
        slow = lambda dt: squares * 1_000_000.0 <= limit * dt * dt
        if cfg.max_speed < 0 or not slow(cfg.window_us):
            return None
        low, high = 1, cfg.window_us
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if slow(mid) else (mid + 1, high)
        return low

    by_squares = {d: least(d) for d in {a * a + b * b for a in range(r + 1) for b in range(r + 1)} if d <= r * r}
    around = [(dx, dy, by_squares.get(dx * dx + dy * dy)) for dx in range(-r, r + 1) for dy in range(-r, r + 1)]
    return [o for o in around if o[2] is not None]


def _rank_sums(block: list[np.ndarray], cfg: MotionConfig, around: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
    """Sums over the neighbours of the events that lie in their own row's cell; rows (cx, cy, tb, x, y, t, times) are those of whole cells, cell by cell."""
    cx, cy, tb, x, y, t, times = block
    r, w = cfg.radius_px, cfg.window_us
    side, span = CELL * r, CELL * w
    wide, long = side + 2 * r, span + w
    cell = np.cumsum(np.concatenate([[False], (cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1]) | (tb[1:] != tb[:-1])]))
    if cell[-1] and wide * wide * long * (int(cell[-1]) + 1) >= 1 << 63:  # keys would not fit: half of the cells at a time
        half = int(np.searchsorted(cell, (cell[-1] + 1) // 2))
        yield from _rank_sums([c[:half] for c in block], cfg, around)
        yield from _rank_sums([c[half:] for c in block], cfg, around)
        return
    # a pixel's place in its cell with the margins around it, then the time since the bucket's beginning less a window
    place = (cell * wide + y - cy * side + r) * wide + x - cx * side + r
    since = t - tb * span + w
    keys = place * long + since
    order = np.argsort(keys, kind="stable")
    keys, totals = keys[order], np.concatenate([[0], np.cumsum(times[order])])
    own = order[(x[order] // side == cx[order]) & (y[order] // side == cy[order]) & (t[order] // span == tb[order])]
    at = place[own] * long + since[own]
    sums = np.zeros((len(SUMS), len(own)), np.int64)
    for dx, dy, least in around:
        there = at - (dy * wide + dx) * long
        count = totals[np.searchsorted(keys, there - least, "right")] - totals[np.searchsorted(keys, there - w, "left")]
        for row, factor in enumerate((1, dx, dy, dx * dx, dy * dy, dx * dy)):
            if factor:
                sums[row] += factor * count
    some = sums[0] > 0
    columns = [x[own][some], y[own][some], t[own][some], *sums[:, some]]
    yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["x", "y", "t", *SUMS])


def rank_batches(batches: Iterable[pa.RecordBatch], cfg: MotionConfig, around: list[tuple[int, int, int]], block_rows: int = BLOCK_ROWS) -> Iterator[pa.RecordBatch]:
    """Sums of rows that come cell by cell, worked through in blocks of whole cells of block_rows rows or little more."""
    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if size >= block_rows:
            other = np.logical_or.reduce([c != last[-1] for c, last in zip(new[:3], held[-1])])
            if other.any():  # what is held and the rows before the first of another cell are whole cells
                first = int(other.argmax())
                yield from _rank_sums([np.concatenate(c) for c in zip(*held, [c[:first] for c in new])], cfg, around)
                new, held, size = [c[first:] for c in new], [], 0
        held.append(new)
        size += len(new[0])
    if held:
        yield from _rank_sums([np.concatenate(c) for c in zip(*held)], cfg, around)


def neighbor_stats(points: DataFrame, cfg: MotionConfig = MotionConfig()) -> DataFrame:
    """x, y, t, n, and sums of neighbour offsets for the places and times of events with at least one neighbour; nulls have none."""
    side, span, r, w = CELL * cfg.radius_px, CELL * cfg.window_us, cfg.radius_px, cfg.window_us
    around = offsets(cfg)
    wide = [F.col(c).cast("long").alias(c) for c in ("x", "y", "t")]
    rows = points.where("x is not null and y is not null and t is not null").groupBy(*wide).agg(F.count("*").alias("times"))
    floor = lambda c, n: F.floor(c / n).cast("long")
    reach = lambda c: F.sequence(floor(F.col(c) - r, side), floor(F.col(c) + r, side))
    # an event is looked at from later ones only, so in time it goes to its own bucket and the next
    rows = rows.withColumn("cx", F.explode(reach("x"))).withColumn("cy", F.explode(reach("y")))
    rows = rows.withColumn("tb", F.explode(F.sequence(floor(F.col("t"), span), floor(F.col("t") + w, span))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return rank_batches(batches, cfg, around)

    cells = rows.select("cx", "cy", "tb", "x", "y", "t", "times").repartition("cx", "cy", "tb").sortWithinPartitions("cx", "cy", "tb")
    return cells.mapInArrow(run, "x long, y long, t long, " + ", ".join(f"{s} long" for s in SUMS))


def motion_filter(points: DataFrame, cfg: MotionConfig = MotionConfig()) -> DataFrame:
    """points with neighbors, coherence and keep.

    An event stays with at least min_neighbors neighbours and, unless support_only, offsets along a line: the larger
    eigenvalue of their covariance has at least min_coherence of both. Without any neighbour there is no coherence.
    """
    if cfg.radius_px <= 0 or cfg.window_us <= 0:
        return points.withColumns({"neighbors": F.lit(0).cast("long"), "coherence": F.lit(0.0), "keep": F.lit(False)})
    stats = neighbor_stats(points, cfg)
    n, free = F.col("n").cast("double"), F.greatest(F.col("n") - 1, F.lit(1)).cast("double")
    cov = lambda xy, x, y: (F.col(xy) - F.col(x) * F.col(y) / n) / free
    a, b, c = cov("sxx", "sx", "sx"), cov("sxy", "sx", "sy"), cov("syy", "sy", "sy")
    stats = stats.select("x", "y", "t", "n", a.alias("a"), b.alias("b"), c.alias("c"))
    root = F.sqrt((F.col("a") - F.col("c")) * (F.col("a") - F.col("c")) / 4 + F.col("b") * F.col("b"))
    first = (F.col("a") + F.col("c")) / 2 + root
    stats = stats.select("x", "y", "t", F.col("n").alias("__n"), (first / (F.col("a") + F.col("c") + 1e-6)).alias("__coherence"))
    rows = points.join(stats, ["x", "y", "t"], "left")
    neighbors, coherence = F.coalesce("__n", F.lit(0)), F.coalesce("__coherence", F.lit(0.0))
    keep = neighbors >= cfg.min_neighbors
    if not cfg.support_only:
        keep &= coherence >= cfg.min_coherence
    return rows.select(*points.columns, neighbors.alias("neighbors"), coherence.alias("coherence"), keep.alias("keep"))


def filter_summary(filtered: DataFrame) -> DataFrame:
    """raw, kept, rejected, percentages, mean and median neighbours (over all rows, zeros too)."""
    sums = filtered.agg(F.count("*").alias("raw"), F.count_if("keep").alias("kept"), F.avg("neighbors").alias("mean_neighbors"), F.percentile("neighbors", F.lit(0.5)).alias("median_neighbors"))
    share = lambda c: F.when(F.col("raw") > 0, F.col(c) * 100.0 / F.col("raw")).otherwise(0.0)
    sums = sums.withColumn("rejected", F.col("raw") - F.col("kept"))
    return sums.select("raw", "kept", "rejected", share("kept").alias("kept_pct"), share("rejected").alias("rejected_pct"), F.coalesce("mean_neighbors", F.lit(0.0)).alias("mean_neighbors"), F.coalesce("median_neighbors", F.lit(0.0)).alias("median_neighbors"))
