"""The ``events`` table read as sensor readings, and its registered topology."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import SENSORS_PER_ZONE, ZONES_PER_FLOOR

EVENT_TYPES = {"click": "temperature", "error": "humidity", "purchase": "co2", "signup": "occupancy", "view": "energy"}


def readings(spark: SparkSession, sf_dir: str, *, sensor_type: str | None = None, with_arrival: bool = False) -> DataFrame:
    """sensor_id, ts_ms, value, sensor_type; with_arrival adds the order in which readings came.

    A type is filtered by the stored event type, so that the filter reaches the scan.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    if sensor_type is not None:
        events = events.filter(F.col("event_type").isin([e for e, t in EVENT_TYPES.items() if t == sensor_type]))
    # the stored wall clock is UTC, whatever the session's zone
    ts = F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())
    names = F.create_map(*[F.lit(x) for x in chain(*EVENT_TYPES.items())])
    events = events.withColumn("_us", F.unix_micros(ts))
    columns = [F.col("user_id").alias("sensor_id"), F.expr("_us div 1000").alias("ts_ms"), F.col("value"), names[F.col("event_type")].alias("sensor_type")]
    return events.select(*columns, *([F.col("event_id").alias("arrival")] if with_arrival else []))


def sensor_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sensor_id, zone_id: every sensor is registered to one zone."""
    ids = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("sensor_id")).distinct()
    return ids.withColumn("zone_id", F.expr(f"sensor_id div {SENSORS_PER_ZONE}"))


def zone_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """zone_id, floor_id: every zone is registered to one floor."""
    return sensor_zone(spark, sf_dir).select("zone_id").distinct().withColumn("floor_id", F.expr(f"zone_id div {ZONES_PER_FLOOR}"))
