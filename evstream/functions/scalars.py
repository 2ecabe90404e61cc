"""Scalar functions of events as Catalyst expressions, and their registration as SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def event_timestamp(sec: str = "sec", ms: str = "ms", us: str = "us") -> Column:
    """Microseconds; the parts are not bounded, so they are widened before the sum."""
    return F.col(sec).cast("long") * 1_000_000 + F.col(ms).cast("long") * 1000 + F.col(us).cast("long")


def in_bounds(width: int, height: int, x: str = "x", y: str = "y") -> Column:
    return (F.col(x) >= 0) & (F.col(x) < width) & (F.col(y) >= 0) & (F.col(y) < height)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(value, F.lit(high)))


def polarity(step: float = 1.0) -> Column:
    """Type 1 adds a step, every other type takes one off."""
    return F.when(F.col("type") == 1, F.lit(float(step))).otherwise(F.lit(-float(step)))


def int_div(a: Column, b: int | Column) -> Column:
    """Integer division that truncates (negative operands need a guard where a floor is meant)."""
    return F.call_function("div", a.cast("long"), (F.lit(b) if isinstance(b, int) else b).cast("long"))


def phase_bin(seconds: Column, freq_hz: float | Column, bins: int = 64) -> Column:
    turn = F.pmod(seconds * (F.lit(float(freq_hz)) if not isinstance(freq_hz, Column) else freq_hz), F.lit(1.0))
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(turn * bins))).cast("int")


def circular_distance(a: Column, b: Column, bins: int = 64) -> Column:
    return F.least(F.abs(a - b), bins - F.abs(a - b))


def tile_id(tile_px: int, width: int, x: str = "x", y: str = "y") -> Column:
    return int_div(F.col(y), tile_px) * ((width + tile_px - 1) // tile_px) + int_div(F.col(x), tile_px)


def grid_cell(value: str, extent: int, grid: int) -> Column:
    """Cell whose half-open interval between the edges i * extent div grid has the value."""
    edges = [i * extent // grid for i in range(1, grid)]
    return sum((F.when(F.col(value) >= e, 1).otherwise(0) for e in edges), F.lit(0)).cast("int")


def speed(dx: Column, dy: Column, dt_us: Column) -> Column:
    """Pixels a millisecond."""
    return F.hypot(dx, dy) / (dt_us / F.lit(1000.0))


def quantize(value: Column) -> Column:
    """Clip to 0..255 and truncate."""
    return F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), value))).cast("smallint")


SQL_FUNCTIONS = {
    "ev_timestamp": ("sec BIGINT, ms BIGINT, us BIGINT", "BIGINT", "sec * 1000000 + ms * 1000 + us"),
    "ev_polarity": ("type INT, step DOUBLE", "DOUBLE", "CASE WHEN type = 1 THEN step ELSE -step END"),
    "ev_phase_bin": ("seconds DOUBLE, freq DOUBLE, bins INT", "INT", "CAST(least(bins - 1, greatest(0, floor(pmod(seconds * freq, 1.0D) * bins))) AS INT)"),
    "ev_circular_distance": ("a INT, b INT, bins INT", "INT", "least(abs(a - b), bins - abs(a - b))"),
    "ev_tile": ("x BIGINT, y BIGINT, size BIGINT, width BIGINT", "BIGINT", "(y div size) * ((width + size - 1) div size) + x div size"),
}


def register_functions(spark: SparkSession) -> None:
    """Make the scalar functions callable in SQL text; Catalyst inlines their bodies."""
    for name, (params, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")
