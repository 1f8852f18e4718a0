"""Sensors near a point, and sensors up the zone tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import position, squared_distance
from .system import sensor_ids
from .topology import sensors_by_zone


def spatial_radius(readings: DataFrame, center: tuple[float, float, float], radius: float) -> DataFrame:
    """Sensors with readings whose position, which follows from the id, is no farther than the radius."""
    near = squared_distance(position(F.col("sensor_id")), center) <= F.lit(float(radius) ** 2)
    return sensor_ids(readings).filter(near)


def zone_hierarchy(readings: DataFrame, sensor_zone: DataFrame, zone_floor: DataFrame, zone_id: int, depth: int) -> DataFrame:
    """Depth 0: the zone's registered sensors. 1: those of its floor. From 2 on: all sensors with readings."""
    if depth <= 0:
        return sensors_by_zone(sensor_zone, zone_id).select("sensor_id")
    if depth >= 2:
        return sensor_ids(readings)
    own = zone_floor.filter(F.col("zone_id") == zone_id).select("floor_id")
    zones = zone_floor.join(own, "floor_id", "left_semi").select("zone_id")
    return sensor_zone.join(zones, "zone_id", "left_semi").select("sensor_id")
