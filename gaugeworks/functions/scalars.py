"""Buckets of time, hours of the day, positions, distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import DAY_MS


def bucket(ts: Column, width_ms: int) -> Column:
    """Start of the bucket, towards minus infinity."""
    return ts - F.pmod(ts, F.lit(width_ms).cast("long"))


def hour_of_day(ts: Column) -> Column:
    """UTC hours with fraction, in [0, 24)."""
    return F.pmod(ts, F.lit(DAY_MS).cast("long")) / F.lit(3_600_000.0)


def circular_hours(a: Column, b: Column) -> Column:
    """Distance on the 24-hour clock."""
    d = F.abs(a - b)
    return F.least(d, F.lit(24.0) - d)


def position(sensor_id: Column) -> tuple[Column, Column, Column]:
    """Ten sensors a row, 5 m apart; rows 3 m apart; all on the ground."""
    return F.pmod(sensor_id, F.lit(10)) * F.lit(5.0), F.floor(sensor_id / F.lit(10)) * F.lit(3.0), F.lit(0.0)


def squared_distance(p: tuple[Column, Column, Column], q: tuple[float, float, float]) -> Column:
    return sum(((a - F.lit(float(b))) * (a - F.lit(float(b))) for a, b in zip(p, q, strict=True)), F.lit(0.0))


def placed_count(area_m2: Column, density: Column) -> Column:
    """Sensors for an area, halves rounded up, one at least."""
    return F.greatest(F.lit(1), F.round(area_m2 * density / F.lit(100.0)).cast("int"))


def project(value: Column, low: Column, high: Column, size: float, margin: float) -> Column:
    """Linear map of [low, high] to [margin, size - margin]; a point span lands in the middle."""
    span = high - low
    return F.when(span <= 0, F.lit(size / 2)).otherwise(F.lit(margin) + (value - low) / span * F.lit(size - 2 * margin))
