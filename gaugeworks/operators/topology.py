"""Topology tables: sensor_zone(sensor_id, zone_id) and zone_floor(zone_id, floor_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def register(table: DataFrame, key: str, *, order: str) -> DataFrame:
    """The last registration of every key, by the order column."""
    value = [c for c in table.columns if c not in (key, order)]
    return table.groupBy(key).agg(*[F.max_by(c, order).alias(c) for c in value])


def sensors_by_zone(sensor_zone: DataFrame, zone_id: int | None = None) -> DataFrame:
    out = sensor_zone if zone_id is None else sensor_zone.filter(F.col("zone_id") == zone_id)
    return out.select("sensor_id", "zone_id")


def sensors_by_floor(sensor_zone: DataFrame, zone_floor: DataFrame, floor_id: int | None = None) -> DataFrame:
    """Sensors whose zone has a floor; zones without one drop out."""
    floors = zone_floor if floor_id is None else zone_floor.filter(F.col("floor_id") == floor_id)
    return sensor_zone.join(floors, "zone_id").select("sensor_id", "floor_id")


def floor_of_zone(zone_floor: DataFrame, zone_id: int | None = None) -> DataFrame:
    out = zone_floor if zone_id is None else zone_floor.filter(F.col("zone_id") == zone_id)
    return out.select("zone_id", "floor_id")


def silent_sensors(sensor_zone: DataFrame, readings: DataFrame) -> DataFrame:
    """Registered sensors without readings."""
    return sensor_zone.join(readings.select("sensor_id"), "sensor_id", "left_anti")
