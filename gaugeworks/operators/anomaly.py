"""Outliers by z-score, and sustained breaches of a threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bucket
from ..model import DAY_MS


def type_stats(readings: DataFrame) -> DataFrame:
    """Mean, population deviation and count by type."""
    return readings.groupBy("sensor_type").agg(F.avg("value").alias("mean_value"), F.stddev_pop("value").alias("std_dev"), F.count("*").alias("n"))


def anomalies(readings: DataFrame, k: float, sensor_type: str | None = None) -> DataFrame:
    """Readings more than k population deviations from their type's mean, by sensor and time; none if the type has fewer than two values or equal ones only."""
    rows = readings if sensor_type is None else readings.filter(F.col("sensor_type") == sensor_type)
    stats = rows.groupBy("sensor_type").agg(F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_dev"), F.count("value").alias("_n"), F.min("value").alias("_min"), F.max("value").alias("_max"))
    # rounding can give equal values a tiny deviation, so their extremes decide
    stats = stats.filter("_n >= 2 and _min < _max and _dev > 0").drop("_n", "_min", "_max")
    z = (F.col("value") - F.col("_mean")) / F.col("_dev")
    scored = rows.join(F.broadcast(stats), "sensor_type").withColumn("z_score", z)  # a row a type
    return scored.filter(F.abs("z_score") > F.lit(float(k))).select("sensor_id", "ts_ms", "value", "sensor_type", "z_score").orderBy("sensor_id", "ts_ms", "value", "sensor_type")


def threshold_breach(readings: DataFrame, threshold: float, min_duration_ms: int, sensor_id: int | None = None, slice_ms: int = DAY_MS) -> DataFrame:
    """Each sensor's first run of successive readings above the threshold that lasts long enough.

    A run ends with its last reading above; gaps of time don't split it. Readings
    of equal time are ordered by value.

    Readings are ordered within slices of time, so a sensor's history is not one
    task's work. Of a slice go on: how many readings aren't above, the runs that
    touch its ends, and the first long one between them. A run's number among the
    sensor's is the count of readings not above before it, in this slice and in
    earlier ones, so runs cut by slices meet under one number.
    """
    rows = readings if sensor_id is None else readings.filter(F.col("sensor_id") == sensor_id)
    one = ["sensor_id", "_slice"]
    order = Window.partitionBy(*one).orderBy("ts_ms", "value").rowsBetween(Window.unboundedPreceding, 0)
    above = F.coalesce(F.col("value") > F.lit(float(threshold)), F.lit(False))
    runs = rows.select("sensor_id", "ts_ms", "value", bucket(F.col("ts_ms"), slice_ms).alias("_slice"))
    runs = runs.withColumn("_above", above).withColumn("_run", F.count(F.when(~F.col("_above"), 1)).over(order))
    # readings that aren't above make one row a slice, with their count
    parts = runs.groupBy(*one, "_above", F.when(F.col("_above"), F.col("_run")).alias("_run")).agg(F.min("ts_ms").alias("start_ts"), F.max("ts_ms").alias("end_ts"), F.max("value").alias("peak_value"), F.count("*").alias("_n"))
    whole = Window.partitionBy(*one)
    parts = parts.withColumn("_below", F.coalesce(F.max(F.when(~F.col("_above"), F.col("_n"))).over(whole), F.lit(0)))
    least = F.lit(min_duration_ms).cast("long")
    inner = F.when(F.col("_above") & (F.col("_run") > 0) & (F.col("_run") < F.col("_below")) & (F.col("end_ts") - F.col("start_ts") >= least), F.col("_run"))
    parts = parts.withColumn("_inner", F.min(inner).over(whole))
    parts = parts.filter(~F.col("_above") | (F.col("_run") == 0) | (F.col("_run") == F.col("_below")) | (F.col("_run") == F.col("_inner")))
    earlier = Window.partitionBy("sensor_id").orderBy("_slice").rangeBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(~F.col("_above"), F.col("_n"))).over(earlier), F.lit(0))
    parts = parts.withColumn("_run", before + F.col("_run")).filter("_above")
    merged = parts.groupBy("sensor_id", "_run").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.max("peak_value").alias("peak_value"))
    merged = merged.withColumn("duration_ms", F.col("end_ts") - F.col("start_ts")).filter(F.col("duration_ms") >= least)
    first = merged.groupBy("sensor_id").agg(F.min(F.struct("_run", "start_ts", "end_ts", "duration_ms", "peak_value")).alias("first"))
    return first.select("sensor_id", "first.start_ts", "first.end_ts", "first.duration_ms", "first.peak_value")
