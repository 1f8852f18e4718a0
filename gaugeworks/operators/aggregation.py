"""Averages and extremes over trailing windows, both ends included.

The window's end is found by an aggregation that is reduced before its shuffle
and joined back, so readings themselves move only if the keys are too many to
broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import HOUR_MS
from .topology import sensors_by_floor, sensors_by_zone


def _trailing(readings: DataFrame, keys: list[str], window_ms: int) -> DataFrame:
    """Rows no older than the window before the latest of their key."""
    latest = readings.groupBy(*keys).agg(F.max("ts_ms").alias("_latest"))
    joined = readings.join(latest, keys) if keys else readings.crossJoin(F.broadcast(latest))
    return joined.filter(F.col("ts_ms") >= F.col("_latest") - F.lit(window_ms).cast("long")).drop("_latest")


def avg_window(readings: DataFrame, hours: int, sensor_id: int | None = None) -> DataFrame:
    """Mean over the hours before a sensor's latest reading of any type; for one sensor 0 without readings."""
    if sensor_id is None:
        return _trailing(readings, ["sensor_id"], hours * HOUR_MS).groupBy("sensor_id").agg(F.avg("value").alias("avg_value"))
    own = readings.filter(F.col("sensor_id") == sensor_id)
    return _trailing(own, [], hours * HOUR_MS).agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("avg_value"))


def avg_zone_type(readings: DataFrame, sensor_zone: DataFrame, hours: int, zone_id: int | None = None, sensor_type: str | None = None) -> DataFrame:
    """Mean by zone and type over the hours before their latest reading; for one zone and type 0 without readings."""
    if zone_id is None:
        rows = readings.join(sensor_zone, "sensor_id")
        return _trailing(rows, ["zone_id", "sensor_type"], hours * HOUR_MS).groupBy("zone_id", "sensor_type").agg(F.avg("value").alias("avg_value"))
    rows = readings.filter(F.col("sensor_type") == sensor_type).join(sensors_by_zone(sensor_zone, zone_id), "sensor_id", "left_semi")
    return _trailing(rows, [], hours * HOUR_MS).agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("avg_value"))


def floor_stats(readings: DataFrame, sensor_zone: DataFrame, zone_floor: DataFrame, hours: int, floor_id: int | None = None, sensor_type: str | None = None) -> DataFrame:
    """Least, largest and mean by floor and type over the hours before their latest reading; for one floor and type zeros without readings."""
    stats = [F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.avg("value").alias("avg_value")]
    members = sensors_by_floor(sensor_zone, zone_floor, floor_id)
    if floor_id is None:
        return _trailing(readings.join(members, "sensor_id"), ["floor_id", "sensor_type"], hours * HOUR_MS).groupBy("floor_id", "sensor_type").agg(*stats)
    rows = readings.filter(F.col("sensor_type") == sensor_type).join(members, "sensor_id", "left_semi")
    out = _trailing(rows, [], hours * HOUR_MS).agg(*stats)
    return out.select(*[F.coalesce(c, F.lit(0.0)).alias(c) for c in out.columns])
