"""Deterministic readings at the benchmark's tiers, with their topology."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.noise import uniform
from ..model import BASE_TS, HOUR_MS, SEED, SENSORS_PER_ZONE, ZONES_PER_FLOOR

# The types of the default fixture's ten sensors, and of scaled fixtures by id.
DEFAULT_TYPES = ["temperature", "temperature", "temperature", "humidity", "humidity", "co2", "co2", "occupancy", "occupancy", "energy"]
SCALED_TYPES = ["temperature", "humidity", "co2", "occupancy", "energy"]


class Dataset(NamedTuple):
    readings: DataFrame
    sensor_zone: DataFrame
    zone_floor: DataFrame


def dataset(spark: SparkSession, sensors: int = 10, per_sensor: int = 50, seed: int = SEED, scaled: bool = False) -> Dataset:
    """Hourly readings of 10 + 5 u + sensor, u uniform by seed, sensor and hour."""
    types = SCALED_TYPES if scaled else DEFAULT_TYPES
    ids = spark.range(sensors).withColumnRenamed("id", "sensor_id")
    grid = ids.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(per_sensor - 1).cast("long"))))
    named = F.array(*[F.lit(t) for t in types])
    rows = grid.select(
        "sensor_id",
        (F.lit(BASE_TS) + F.col("step") * F.lit(HOUR_MS)).alias("ts_ms"),
        (F.lit(10.0) + 5 * uniform(seed, "sensor_id", "step") + F.col("sensor_id")).alias("value"),
        F.get(named, F.pmod("sensor_id", F.lit(len(types))).cast("int")).alias("sensor_type"),
    )
    zones = ids.withColumn("zone_id", F.expr(f"sensor_id div {SENSORS_PER_ZONE}"))
    floors = zones.select("zone_id").distinct().withColumn("floor_id", F.expr(f"zone_id div {ZONES_PER_FLOOR}"))
    return Dataset(rows, zones, floors)
