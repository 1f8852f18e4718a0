"""Readings by profile, as expressions and windows over each sensor's grid of times.

Noise comes from hashes of seed, sensor and sample, so that readings don't
depend on partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.noise import normal, uniform
from ..functions.scalars import circular_hours, hour_of_day
from ..model import SEED, profiles

# Chance of a new draw and bounds of its likelihood; chance and reach of bursts; least hold of a level and its spread; jitter of levels.
REROLL, LIKELY_LOW, LIKELY_HIGH, LIKELY_HOURS = 0.15, 0.05, 0.95, 6.0
BURST, BURST_LOW, BURST_SPREAD = 0.02, 3.0, 4.0
HOLD, HOLD_SPREAD, JITTER = 4, 8, 0.2


def _bounded(value: Column) -> Column:
    return F.greatest(F.col("min_value"), F.least(F.col("max_value"), value))


def _daily(ts: Column) -> Column:
    phase = (hour_of_day(ts) - F.col("peak_hour")) * F.lit(2 * math.pi / 24)
    return F.col("base") + F.col("amplitude") * F.cos(phase)


def _samples(sensors: DataFrame, start: int, end: int) -> DataFrame:
    """Columns step and ts_ms; the end is excluded."""
    count = F.ceil((F.lit(end) - F.lit(start)) / F.col("period_ms"))
    steps = F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(F.array().cast("array<long>"))
    return sensors.withColumn("step", F.explode(steps)).withColumn("ts_ms", F.lit(start).cast("long") + F.col("step") * F.col("period_ms"))


def _diurnal(rows: DataFrame, seed: int) -> DataFrame:
    return rows.withColumn("value", _bounded(_daily(F.col("ts_ms")) + normal(seed, "sensor_id", "step") * F.col("noise")))


def _bursty(rows: DataFrame, seed: int) -> DataFrame:
    burst = F.col("amplitude") * (F.lit(BURST_LOW) + uniform(seed + 1, "sensor_id", "step") * F.lit(BURST_SPREAD))
    quiet = normal(seed, "sensor_id", "step") * F.col("noise")
    return rows.withColumn("value", _bounded(F.col("base") + F.when(uniform(seed + 2, "sensor_id", "step") < BURST, burst).otherwise(quiet)))


def _binary(rows: DataFrame, seed: int) -> DataFrame:
    """A state lasts until a draw is repeated, more likely occupied near the peak hour."""
    away = circular_hours(hour_of_day(F.col("ts_ms")), F.col("peak_hour"))
    likely = F.greatest(F.lit(LIKELY_LOW), F.least(F.lit(LIKELY_HIGH), 1 - away / LIKELY_HOURS))
    drawn = F.when(uniform(seed + 1, "sensor_id", "step") < REROLL, (uniform(seed + 2, "sensor_id", "step") < likely).cast("double"))
    before = Window.partitionBy("sensor_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_drawn", drawn).withColumn("value", F.coalesce(F.last("_drawn", ignorenulls=True).over(before), F.lit(0.0))).drop("_drawn")


def _stepwise(sensors: DataFrame, seed: int, start: int, end: int) -> DataFrame:
    """Levels hold for some samples each; holds are summed to find their first samples."""
    count = F.ceil((F.lit(end) - F.lit(start)) / F.col("period_ms"))
    holds = sensors.withColumn("_n", count).filter("_n > 0").withColumn("_hold", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_n") / HOLD))))
    holds = holds.withColumn("_length", F.lit(HOLD) + F.floor(uniform(seed + 1, "sensor_id", "_hold") * HOLD_SPREAD))
    until = F.sum("_length").over(Window.partitionBy("sensor_id").orderBy("_hold"))
    holds = holds.withColumn("_from", until - F.col("_length")).filter("_from < _n")
    step = F.greatest(F.col("amplitude") / 3, F.lit(0.01))
    held = holds.withColumn("_level", _bounded(F.round(_daily(F.lit(start).cast("long") + F.col("_from") * F.col("period_ms")) / step) * step))
    rows = held.withColumn("step", F.explode(F.sequence("_from", F.least(F.col("_from") + F.col("_length"), F.col("_n")) - 1)))
    rows = rows.withColumn("ts_ms", F.lit(start).cast("long") + F.col("step") * F.col("period_ms"))
    return rows.withColumn("value", _bounded(F.col("_level") + normal(seed, "sensor_id", "step") * F.col("noise") * JITTER))


def generate(sensors: DataFrame, start: int, end: int, seed: int = SEED) -> DataFrame:
    """sensors: sensor_id, sensor_type. Their readings from start to before end."""
    known = sensors.select("sensor_id", "sensor_type").join(F.broadcast(profiles(sensors.sparkSession)), "sensor_type")
    of = lambda shape: known.filter(F.col("shape") == shape)
    parts = [
        _diurnal(_samples(of("diurnal"), start, end), seed),
        _bursty(_samples(of("bursty"), start, end), seed),
        _binary(_samples(of("binary"), start, end), seed),
        _stepwise(of("stepwise"), seed, start, end),
    ]
    columns = ["sensor_id", "ts_ms", "value", "sensor_type"]
    out = parts[0].select(columns)
    for part in parts[1:]:
        out = out.unionByName(part.select(columns))
    return out
