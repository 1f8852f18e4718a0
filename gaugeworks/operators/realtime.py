"""Latest readings. Of equal timestamps the larger value counts as the later one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .topology import sensors_by_zone


def latest_single(readings: DataFrame, sensor_id: int | None = None) -> DataFrame:
    """Each sensor's latest reading, or that of one; no row without readings.

    One aggregation of the largest (time, value, type), reduced before the shuffle.
    """
    rows = readings if sensor_id is None else readings.filter(F.col("sensor_id") == sensor_id)
    last = rows.groupBy("sensor_id").agg(F.max(F.struct("ts_ms", "value", "sensor_type")).alias("last"))
    return last.select("sensor_id", "last.ts_ms", "last.value", "last.sensor_type")


def latest_zone(readings: DataFrame, sensor_zone: DataFrame, zone_id: int) -> DataFrame:
    """Latest reading of every sensor registered to the zone that has any."""
    return latest_single(readings.join(sensors_by_zone(sensor_zone, zone_id), "sensor_id", "left_semi"))


def latest_by_type(readings: DataFrame, sensor_type: str) -> DataFrame:
    """Each sensor's latest among its readings of the type."""
    return latest_single(readings.filter(F.col("sensor_type") == sensor_type))


def value_at(readings: DataFrame, ts_ms: int) -> DataFrame:
    """Each sensor's reading as of a time: the latest no later than it."""
    return latest_single(readings.filter(F.col("ts_ms") <= F.lit(ts_ms).cast("long")))
