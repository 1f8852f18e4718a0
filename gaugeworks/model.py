"""Record types, and the fixed tables that are part of the queries' meaning."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

HOUR_MS = 3_600_000
DAY_MS = 86_400_000

# The sensor types, in their order.
SENSOR_TYPES = ["temperature", "humidity", "occupancy", "co2", "vibration", "flow", "energy", "structural", "air_quality"]

READINGS = T.StructType(
    [
        T.StructField("sensor_id", T.LongType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("sensor_type", T.StringType()),
    ]
)


@dataclass(frozen=True)
class RangeQuery:
    """Readings from start to end, both included, of one sensor or of all."""

    start: int
    end: int
    sensor_id: int | None = None


@dataclass(frozen=True)
class SensorProfile:
    sensor_type: str
    base: float
    amplitude: float
    peak_hour: float
    noise: float
    min_value: float
    max_value: float
    period_s: int
    shape: str
    density: float
    retention_days: int

    @property
    def period_ms(self) -> int:
        """Milliseconds between samples: the reciprocal of a frequency kept in single precision, cut to whole ones."""
        import numpy as np

        return int(1000.0 / float(np.float32(1.0 / self.period_s)))


# Type, base, amplitude, peak hour, noise, min, max, seconds a sample, shape, sensors per 100 m2, days kept.
PROFILES = [
    SensorProfile("temperature", 21, 3, 15, 0.3, 0, 50, 300, "diurnal", 1.0, 90),
    SensorProfile("humidity", 45, 10, 5, 2, 0, 100, 300, "diurnal", 1.0, 90),
    SensorProfile("occupancy", 0, 0, 13, 0, 0, 1, 60, "binary", 1.0, 365),
    SensorProfile("co2", 450, 350, 14, 20, 350, 5000, 180, "diurnal", 0.5, 365),
    SensorProfile("vibration", 0.05, 0.15, 13, 0.02, 0, 10, 120, "bursty", 1.0, 30),
    SensorProfile("flow", 5, 4, 10, 0.5, 0, 100, 60, "diurnal", 1.5, 90),
    SensorProfile("energy", 2, 6, 13, 0.5, 0, 500, 900, "stepwise", 0.5, 1825),
    SensorProfile("structural", 50, 5, 15, 1, 0, 1000, 600, "diurnal", 0.5, 2555),
    SensorProfile("air_quality", 50, 20, 17, 5, 0, 500, 180, "diurnal", 0.5, 365),
]
PROFILE = {p.sensor_type: p for p in PROFILES}


def profiles(spark: SparkSession) -> DataFrame:
    """The profile table: nine rows, so always small enough to broadcast."""
    schema = "sensor_type string, base double, amplitude double, peak_hour double, noise double, min_value double, max_value double, period_ms long, shape string, density double, retention_days int"
    rows = [(p.sensor_type, float(p.base), float(p.amplitude), float(p.peak_hour), float(p.noise), float(p.min_value), float(p.max_value), p.period_ms, p.shape, p.density, p.retention_days) for p in PROFILES]
    return spark.createDataFrame(rows, schema)


# How much each query counts in a sensor type's workload.
QUERY_MIX = {
    "temperature": {"latest_single": 3, "latest_zone": 3, "avg_window": 3, "avg_zone_type": 2, "hourly_rollup": 2, "daily_zone_rollup": 2, "threshold_breach": 3, "anomalies": 1},
    "humidity": {"latest_single": 2, "latest_zone": 2, "avg_window": 3, "avg_zone_type": 2, "daily_zone_rollup": 2, "threshold_breach": 2},
    "occupancy": {"latest_single": 4, "latest_zone": 5, "avg_zone_type": 3, "daily_zone_rollup": 2, "zone_hierarchy": 2, "spatial_radius": 2},
    "co2": {"latest_single": 3, "latest_zone": 3, "avg_window": 2, "avg_zone_type": 2, "threshold_breach": 4, "anomalies": 2},
    "air_quality": {"latest_single": 3, "latest_zone": 3, "avg_window": 2, "avg_zone_type": 2, "threshold_breach": 4, "anomalies": 2},
    "vibration": {"latest_single": 2, "avg_zone_type": 1, "threshold_breach": 3, "anomalies": 5, "spatial_radius": 2},
    "flow": {"latest_single": 2, "avg_window": 3, "hourly_rollup": 2, "threshold_breach": 3},
    "energy": {"latest_single": 3, "avg_zone_type": 2, "hourly_rollup": 3, "daily_zone_rollup": 3, "threshold_breach": 3, "anomalies": 4},
    "structural": {"latest_single": 2, "avg_zone_type": 2, "daily_zone_rollup": 2, "threshold_breach": 4, "anomalies": 5, "spatial_radius": 2},
}

# The twelve queries and their families.
FAMILIES = {
    "latest_single": "real-time", "latest_zone": "real-time", "latest_by_type": "real-time",
    "avg_window": "aggregation", "avg_zone_type": "aggregation", "floor_stats": "aggregation",
    "hourly_rollup": "historical", "daily_zone_rollup": "historical",
    "spatial_radius": "spatial", "zone_hierarchy": "spatial",
    "anomalies": "anomaly", "threshold_breach": "anomaly",
}
TYPED_QUERIES = {"latest_by_type", "avg_zone_type", "floor_stats", "daily_zone_rollup", "anomalies"}

# The layouts that should win a query.
EXPECTED_WINNERS = {
    "latest_single": ["RingBuffer"], "latest_zone": ["Hierarchical"], "latest_by_type": [],
    "avg_window": ["TimeSeries", "Columnar"], "avg_zone_type": ["TimeSeries", "Columnar"], "floor_stats": ["Columnar"],
    "hourly_rollup": ["Columnar"], "daily_zone_rollup": ["Columnar"],
    "spatial_radius": ["Hierarchical"], "zone_hierarchy": ["Hierarchical"],
    "anomalies": ["TimeSeries", "RingBuffer"], "threshold_breach": ["RingBuffer"],
}

# Fixture topology and benchmark tiers (name, sensors, readings a sensor, iterations).
BASE_TS, SENSORS_PER_ZONE, ZONES_PER_FLOOR, SEED = 1_000_000, 5, 2, 42
TIERS = [("Small", 10, 50, 25), ("Medium", 50, 200, 25), ("Large", 100, 500, 25)]
RING_CAPACITY = 1000
DEFAULT_AREA_M2 = 100.0

# Which sensors an element of a building gets.
PLACEMENT_RULES = {"space": ["temperature", "humidity", "occupancy"], "flow_segment": ["flow", "temperature"], "beam": ["structural"], "equipment": ["energy", "vibration"]}
