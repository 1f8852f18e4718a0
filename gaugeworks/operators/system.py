"""Counts, scans and averages over all readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import RangeQuery


def in_range(readings: DataFrame, query: RangeQuery) -> DataFrame:
    """Readings within the range, both ends included; an inverted range is empty."""
    out = readings.filter(F.col("ts_ms").between(query.start, query.end))
    return out if query.sensor_id is None else out.filter(F.col("sensor_id") == query.sensor_id)


def total_count(readings: DataFrame) -> DataFrame:
    return readings.agg(F.count("*").alias("n"))


def average(readings: DataFrame) -> DataFrame:
    """Mean of all values, 0 without any."""
    return readings.agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("avg_value"))


def average_in_range(readings: DataFrame, query: RangeQuery) -> DataFrame:
    return average(in_range(readings, query))


def count_for_sensor(readings: DataFrame, sensor_id: int, query: RangeQuery) -> DataFrame:
    """The sensor of the argument counts, not that of the range."""
    return total_count(in_range(readings, RangeQuery(query.start, query.end, sensor_id)))


def sensor_ids(readings: DataFrame) -> DataFrame:
    """Sensors with readings."""
    return readings.select("sensor_id").distinct()
