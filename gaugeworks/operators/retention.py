"""What is kept, and whether values are plausible."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import circular_hours, hour_of_day
from ..model import DAY_MS, RING_CAPACITY


def prune(readings: DataFrame, sensor_type: str, cutoff_ms: int) -> DataFrame:
    """Without the type's readings from before the cutoff."""
    return readings.filter(~((F.col("sensor_type") == sensor_type) & (F.col("ts_ms") < F.lit(cutoff_ms).cast("long"))))


def prune_by_profile(readings: DataFrame, profiles: DataFrame) -> DataFrame:
    """Without readings older than their type's retention before the latest reading of all; types without a profile stay."""
    now = readings.agg(F.max("ts_ms").alias("_now"))
    kept_days = profiles.select("sensor_type", F.col("retention_days").alias("_days"))
    rows = readings.crossJoin(F.broadcast(now)).join(F.broadcast(kept_days), "sensor_type", "left")
    old = F.col("ts_ms") < F.col("_now") - F.col("_days").cast("long") * F.lit(DAY_MS).cast("long")
    return rows.filter(~F.coalesce(old, F.lit(False))).select(*readings.columns)


def keep_last(readings: DataFrame, n: int = RING_CAPACITY, *arrival: str) -> DataFrame:
    """The last n readings of every sensor by arrival (its columns, ``arrival`` if none are named), not by time."""
    order = Window.partitionBy("sensor_id").orderBy(*[F.col(c).desc() for c in arrival or ("arrival",)])
    return readings.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n).drop("_rank")


def bounds_violations(readings: DataFrame, profiles: DataFrame) -> DataFrame:
    """Readings outside their type's bounds, with the bounds."""
    bounds = profiles.select("sensor_type", "min_value", "max_value")
    out = readings.join(F.broadcast(bounds), "sensor_type").filter("value < min_value or value > max_value")
    return out.select("sensor_id", "ts_ms", "value", "sensor_type", "min_value", "max_value")


def daily_pattern(readings: DataFrame, profiles: DataFrame) -> DataFrame:
    """By type: does the mean within two hours of the peak exceed that of the trough by half the amplitude?

    True without amplitude, false without samples on either side. Every profile gets a row.
    """
    hour = hour_of_day(F.col("ts_ms"))
    trough = F.pmod(F.col("peak_hour") + 12, F.lit(24.0))
    shape = profiles.select("sensor_type", "peak_hour", "amplitude")
    rows = readings.join(F.broadcast(shape), "sensor_type")
    means = rows.groupBy("sensor_type").agg(F.avg(F.when(circular_hours(hour, F.col("peak_hour")) <= 2, F.col("value"))).alias("peak_avg"), F.avg(F.when(circular_hours(hour, trough) <= 2, F.col("value"))).alias("trough_avg"))
    verdict = F.when(F.col("amplitude") == 0, True).otherwise(F.coalesce(F.col("peak_avg") - F.col("trough_avg") >= 0.5 * F.col("amplitude"), F.lit(False)))
    return shape.join(means, "sensor_type", "left").select("sensor_type", "peak_avg", "trough_avg", verdict.alias("has_pattern"))
