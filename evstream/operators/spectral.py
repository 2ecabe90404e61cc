"""Spectra of count signals, band ratios and dominant frequencies."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FlickerConfig, Sensor
from ..functions.scalars import grid_cell
from .signal import burst_clip, count_signal, rate_histogram

FLAT = 1e-8  # deviations up to this count as none
SHORTEST = 16  # bins
ONE_ARRAY = 1 << 24  # bins of a signal that one task takes: 134 MB, and as much for its transform
BLOCK = 1 << 20  # complex numbers of each of two matrices that a task of a longer transform holds
LONGEST = 3_000_000_000  # bins: squares of places fit 63 bits


def band_bins(n: int, bin_us: int, low_hz: float, high_hz: float) -> tuple[int, int]:
    """First and last frequency bin inside a closed band."""
    hz = 1_000_000.0 / (n * bin_us)
    first, last = max(0, math.ceil(low_hz / hz - 1e-9)), min(n // 2, math.floor(high_hz / hz + 1e-9))
    return first, last


def frequency(k: Column, n: int, bin_us: int) -> Column:
    return k * F.lit(1_000_000.0) / F.lit(float(n * bin_us))


def fft_power(signal: DataFrame, n: int, bin_us: int, first: int | None = None, last: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, k, freq_hz, power of bins first..last of a dense signal (bin, c): mean removed, Hann window, squared magnitude.

    A signal of up to ONE_ARRAY bins is one array for numpy's transform; a longer one, only without keys, is joined with the wanted bins.
    Signals under 16 bins or without deviation have no power.
    """
    first, last = 0 if first is None else first, n // 2 if last is None else last
    if keys or n <= ONE_ARRAY:
        return _by_array(signal, n, bin_us, first, last, keys)
    return _joined(signal, n, bin_us, first, last)


def _joined(signal: DataFrame, n: int, bin_us: int, first: int, last: int) -> DataFrame:
    mean = signal.agg(F.avg("c").alias("__mean"))
    rows = signal.crossJoin(F.broadcast(mean)).withColumn("d", F.col("c") - F.col("__mean"))
    live = rows.agg((F.max(F.abs("d")) > FLAT).alias("__live")).withColumn("__live", F.col("__live") & F.lit(n >= SHORTEST))
    v = F.col("d") * (0.5 - 0.5 * F.cos(F.lit(2 * math.pi / max(1, n - 1)) * F.col("bin")))
    rows = rows.select("bin", v.alias("v"))
    wanted = F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long")))
    turn = F.lit(2 * math.pi) * ((F.col("k") * F.col("bin")) % n) / n
    rows = rows.withColumn("k", wanted).groupBy("k").agg(F.sum(F.col("v") * F.cos(turn)).alias("re"), F.sum(F.col("v") * F.sin(turn)).alias("im"))
    power = F.when(F.col("__live"), F.col("re") * F.col("re") + F.col("im") * F.col("im")).otherwise(0.0)
    return rows.crossJoin(F.broadcast(live)).select("k", frequency(F.col("k"), n, bin_us).alias("freq_hz"), power.alias("power"))


def _by_array(signal: DataFrame, n: int, bin_us: int, first: int, last: int, keys: tuple[str, ...]) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in signal.schema.fields}

    def transform(table: pa.Table) -> pa.Table:
        c = np.zeros(n)
        c[table["bin"].to_numpy()] = table["c"].to_numpy()
        d = c - c.mean()
        power = np.zeros(n // 2 + 1) if n < SHORTEST or np.abs(d).max() <= FLAT else np.abs(np.fft.rfft(d * np.hanning(n))) ** 2
        k = np.arange(first, last + 1)
        out = {key: pa.array([table[key][0].as_py()] * len(k), table[key].type) for key in keys}
        return pa.table(out | {"k": k, "freq_hz": k * 1e6 / (n * bin_us), "power": power[first : last + 1]})

    fields = [f"{k} {kinds[k]}" for k in keys]
    return signal.groupBy(*keys).applyInArrow(transform, ", ".join([*fields, "k long", "freq_hz double", "power double"]))


def band_ratio(spectrum: DataFrame, cfg: FlickerConfig = FlickerConfig(), keys: tuple[str, ...] = ()) -> DataFrame:
    """ratio of the power around the centre to that of the whole band, both closed; 0 where the band has none. The first need not lie in the second."""
    within = lambda lo, hi: F.sum(F.when((F.col("freq_hz") >= lo) & (F.col("freq_hz") <= hi), F.col("power")).otherwise(0.0))
    sums = spectrum.groupBy(*keys).agg(within(cfg.center_hz - cfg.band_hz, cfg.center_hz + cfg.band_hz).alias("__f"), within(cfg.min_hz, cfg.max_hz).alias("__t"))
    return sums.select(*keys, F.when(F.col("__t") <= 1e-12, 0.0).otherwise(F.col("__f") / F.col("__t")).alias("ratio"))


def _wanted(cfg: FlickerConfig) -> tuple[int, int]:
    return band_bins(cfg.bins, cfg.bin_us, min(cfg.min_hz, cfg.center_hz - cfg.band_hz), max(cfg.max_hz, cfg.center_hz + cfg.band_hz))


def flicker_ratio(events: DataFrame, cfg: FlickerConfig = FlickerConfig(), clipped: bool = False) -> DataFrame:
    """ratio (one row) of the whole sensor; clipped: with bursts cut first, and the threshold."""
    signal = count_signal(events, cfg)
    if clipped:
        signal = burst_clip(signal, cfg.burst_k, cfg.burst_min)
    ratio = band_ratio(fft_power(signal, cfg.bins, cfg.bin_us, *_wanted(cfg)), cfg)
    return ratio.crossJoin(F.broadcast(signal.agg(F.max("threshold").alias("threshold")))) if clipped else ratio


def grid_flicker(events: DataFrame, cfg: FlickerConfig = FlickerConfig(), sensor: Sensor = Sensor()) -> DataFrame:
    """gy, gx, ratio of every grid cell, each by the clock of its own latest event; 0 where a cell is empty."""
    g = cfg.grid
    rows = events.withColumns({"gy": grid_cell("y", sensor.height, g), "gx": grid_cell("x", sensor.width, g)})
    signal = count_signal(rows, cfg, ("gy", "gx"))
    ratio = band_ratio(fft_power(signal, cfg.bins, cfg.bin_us, *_wanted(cfg), keys=("gy", "gx")), cfg, ("gy", "gx"))
    cells = events.sparkSession.range(g * g).select(F.expr(f"cast(id div {g} as int)").alias("gy"), F.expr(f"cast(id % {g} as int)").alias("gx"))
    return cells.join(F.broadcast(ratio), ["gy", "gx"], "left").select("gy", "gx", F.coalesce("ratio", F.lit(0.0)).alias("ratio"))


def fft_magnitude(points: DataFrame, bin_ms: float = 1.0, max_hz: float = 300.0, one_array: int = ONE_ARRAY, block: int = BLOCK) -> DataFrame:
    """k, freq_hz, magnitude from 1 Hz to max_hz of the mean-free rate, without a window. No rows without a duration.

    A signal of up to one_array bins (4.6 hours of milliseconds) is one array for numpy's transform. A longer one, which a
    task should not hold, is a matrix that three shuffles turn; which of the two has rows is found in the run.
    """
    bin_s = bin_ms * 1e-3
    rate = rate_histogram(points, bin_ms)
    size = rate.agg(F.nullif(F.count("*"), F.lit(0)).alias("__n"))
    # the mean adds nothing at any k over 0, so bins without events need not be sent
    hz = 1.0 / (F.col("__n") * F.lit(bin_s))
    last = F.least(F.col("__n").cast("double") / 2, F.floor(F.lit(float(max_hz)) / hz + 1e-9)).cast("long")
    first = F.greatest(F.lit(1), F.ceil(1.0 / hz - 1e-9)).cast("long")
    size = size.withColumns({"__first": first, "__last": last}).where("__first <= __last")
    rows = rate.where("rate <> 0").crossJoin(F.broadcast(size)).select("bin", F.col("rate").alias("v"), "__n", "__first", "__last")

    def transform(table: pa.Table) -> pa.Table:
        v = np.zeros(table["__n"][0].as_py())
        v[table["bin"].to_numpy()] = table["v"].to_numpy()
        k = np.arange(table["__first"][0].as_py(), table["__last"][0].as_py() + 1)
        return pa.table({"k": k, "__n": np.full(len(k), len(v)), "magnitude": np.abs(np.fft.rfft(v)[k])})

    whole = rows.where(F.col("__n") <= one_array).groupBy("__n").applyInArrow(transform, "k long, __n long, magnitude double")
    long = _long_magnitude(rows.where(F.col("__n") > one_array), size.where(F.col("__n") > one_array), block)
    return whole.unionByName(long).select("k", (F.col("k") / (F.col("__n") * F.lit(bin_s))).alias("freq_hz"), "magnitude")


class _Turned:
    """A circular convolution of 2^bits >= 2 n numbers as a matrix of high x wide, and the chirp that makes of it a transform of any n.

    X[k] = chirp(k) sum of v[j] chirp(j) / chirp(k - j), with chirp(j) = exp(-i pi j^2 / n). Place j stands in row j div wide and
    column j mod wide. Columns are transformed, turned by twiddles, rows are transformed, multiplied and transformed back, and so are columns.
    """

    def __init__(self, n: int, block: int) -> None:
        if n > LONGEST:
            raise ValueError(f"a signal of {n} bins; at most {LONGEST}")
        bits = (2 * n - 1).bit_length()
        self.n, self.size, self.high, self.wide = n, 1 << bits, 1 << (bits + 1) // 2, 1 << bits // 2
        self.columns, self.rows = (max(1, min(side, block // other)) for side, other in ((self.wide, self.high), (self.high, self.wide)))

    def chirp(self, j: np.ndarray, sign: float) -> np.ndarray:
        return np.exp(sign * 1j * np.pi * ((j * j) % (2 * self.n)) / self.n)

    def places(self, column_block: int) -> np.ndarray:
        """Place of each entry of a block of columns."""
        return np.arange(self.high)[:, None] * self.wide + column_block * self.columns + np.arange(self.columns)

    def twiddles(self, row_block: int, sign: float) -> np.ndarray:
        """Of a block of whole rows."""
        turns = (row_block * self.rows + np.arange(self.rows))[:, None] * np.arange(self.wide)
        return np.exp(sign * 2j * np.pi * turns / self.size)

    def kernel(self, at: np.ndarray) -> np.ndarray:
        """1 / chirp of the distance, which runs backwards from the end."""
        j = np.minimum(at, self.size - at)
        return np.where(j < self.n, self.chirp(j, 1.0), 0)


def _long_magnitude(rows: DataFrame, size: DataFrame, block: int) -> DataFrame:
    """k, __n, magnitude of rows (bin, v, __n, __first, __last); size has the last three in one row, or none if there is no long signal."""
    bits = F.length(F.bin(F.col("__n") * 2 - 1))
    wide, high = F.expr("shiftleft(1L, cast(__bits div 2 as int))"), F.expr("shiftleft(1L, cast((__bits + 1) div 2 as int))")
    shaped = lambda df: df.withColumn("__bits", bits).withColumn("__wide", wide).withColumn("__columns", F.greatest(F.lit(1), F.least(wide, F.lit(block) / high)).cast("long"))
    keys = "__n long, __first long, __last long"
    every = shaped(size).withColumn("__j", F.explode(F.expr("sequence(0L, __wide div __columns - 1)"))).select("__n", "__first", "__last", "__j", F.lit(None).cast("long").alias("bin"), F.lit(None).cast("double").alias("v"))
    placed = shaped(rows).withColumn("__j", F.expr("(bin % __wide) div __columns")).select("__n", "__first", "__last", "__j", "bin", "v")
    pieces = f"{keys}, __j long, __k long, piece binary"
    head = lambda table: [table[c][0].as_py() for c in ("__n", "__first", "__last")]

    def cut(own: list, js: list[int], ks: list[int], parts: list[np.ndarray]) -> pa.Table:
        fixed = {c: pa.array([v] * len(parts), pa.int64()) for c, v in zip(("__n", "__first", "__last"), own)}
        return pa.table(fixed | {"__j": pa.array(js, pa.int64()), "__k": pa.array(ks, pa.int64()), "piece": pa.array([p.tobytes() for p in parts], pa.binary())})

    def down(table: pa.Table) -> pa.Table:
        own, j = head(table), table["__j"][0].as_py()
        m = _Turned(own[0], block)
        held = table.filter(table["bin"].is_valid())
        at, signal = held["bin"].to_numpy(), np.zeros((m.high, m.columns), complex)
        signal[at // m.wide, at % m.wide - j * m.columns] = held["v"].to_numpy() * m.chirp(at, -1.0)
        both = np.stack([np.fft.fft(signal, axis=0), np.fft.fft(m.kernel(m.places(j)), axis=0)])
        blocks = range(m.high // m.rows)
        return cut(own, [j] * len(blocks), list(blocks), [both[:, k * m.rows : (k + 1) * m.rows] for k in blocks])

    def across(table: pa.Table) -> pa.Table:
        own, k = head(table), table["__k"][0].as_py()
        m = _Turned(own[0], block)
        both = np.zeros((2, m.rows, m.wide), complex)
        for j, piece in zip(table["__j"].to_pylist(), table["piece"]):
            both[:, :, j * m.columns : (j + 1) * m.columns] = np.frombuffer(piece.as_buffer(), complex).reshape(2, m.rows, m.columns)
        both = np.fft.fft(both * m.twiddles(k, -1.0), axis=2)
        back = np.fft.ifft(both[0] * both[1], axis=1) * m.twiddles(k, 1.0)
        blocks = range(m.wide // m.columns)
        return cut(own, list(blocks), [k] * len(blocks), [back[:, j * m.columns : (j + 1) * m.columns] for j in blocks])

    def up(table: pa.Table) -> pa.Table:
        (n, first, last), j = head(table), table["__j"][0].as_py()
        m = _Turned(n, block)
        whole = np.zeros((m.high, m.columns), complex)
        for k, piece in zip(table["__k"].to_pylist(), table["piece"]):
            whole[k * m.rows : (k + 1) * m.rows] = np.frombuffer(piece.as_buffer(), complex).reshape(m.rows, m.columns)
        at = m.places(j)
        wanted = (at >= first) & (at <= last)
        return pa.table({"k": at[wanted], "__n": np.full(wanted.sum(), n), "magnitude": np.abs(np.fft.ifft(whole, axis=0)[wanted])})

    turned = placed.unionByName(every).groupBy("__n", "__j").applyInArrow(down, pieces).groupBy("__n", "__k").applyInArrow(across, pieces)
    return turned.groupBy("__n", "__j").applyInArrow(up, "k long, __n long, magnitude double")


def dominant_frequency(points: DataFrame, bin_ms: float = 1.0, max_hz: float = 300.0) -> DataFrame:
    """freq_hz (one row): the first of the largest magnitudes from 1 Hz to max_hz; 1.0 where there is none."""
    best = fft_magnitude(points, bin_ms, max_hz).agg(F.max_by("freq_hz", F.struct(F.round("magnitude", 6), -F.col("k"))).alias("f"))
    return best.select(F.coalesce("f", F.lit(1.0)).alias("freq_hz"))


def top_peaks(spectrum: DataFrame, low_hz: float, high_hz: float, k: int = 5) -> DataFrame:
    """freq_hz, power, rel of the k strongest bins in a closed band, the lower frequency first among equals; none where all are 0."""
    band = spectrum.where((F.col("freq_hz") >= low_hz) & (F.col("freq_hz") <= high_hz))
    best = band.agg(F.max("power").alias("__max")).where("__max > 0")
    top = band.orderBy(F.desc("power"), "freq_hz").limit(k)
    return top.crossJoin(F.broadcast(best)).select("freq_hz", "power", (F.col("power") / F.col("__max")).alias("rel"))
