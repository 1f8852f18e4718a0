"""Rollups into the buckets of time that have readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bucket
from ..model import DAY_MS, HOUR_MS
from .aggregation import _trailing
from .topology import sensors_by_zone


def _rollup(rows: DataFrame, keys: list[str], width_ms: int) -> DataFrame:
    stats = [F.avg("value").alias("avg_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.count("*").alias("n")]
    return rows.groupBy(*keys, bucket(F.col("ts_ms"), width_ms).alias("bucket_ms")).agg(*stats)


def hourly_rollup(readings: DataFrame, days: int, sensor_id: int | None = None) -> DataFrame:
    """By hour, over the days before a sensor's latest reading; the first bucket may be partial."""
    if sensor_id is not None:
        return _rollup(_trailing(readings.filter(F.col("sensor_id") == sensor_id), [], days * DAY_MS), [], HOUR_MS)
    return _rollup(_trailing(readings, ["sensor_id"], days * DAY_MS), ["sensor_id"], HOUR_MS)


def daily_zone_rollup(readings: DataFrame, sensor_zone: DataFrame, zone_id: int | None = None, sensor_type: str | None = None, days: int = 365) -> DataFrame:
    """By zone, type and UTC day, over the days before their latest reading."""
    if zone_id is not None:
        rows = readings.filter(F.col("sensor_type") == sensor_type).join(sensors_by_zone(sensor_zone, zone_id), "sensor_id", "left_semi")
        return _rollup(_trailing(rows, [], days * DAY_MS), [], DAY_MS)
    return _rollup(_trailing(readings.join(sensor_zone, "sensor_id"), ["zone_id", "sensor_type"], days * DAY_MS), ["zone_id", "sensor_type"], DAY_MS)
