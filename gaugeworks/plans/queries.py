"""Registered queries: operators over the ``events`` readings, with fixed arguments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bench.recommend import recommend, winners
from ..building import place, resolve, source, write
from ..layouts import LAYOUTS
from ..model import HOUR_MS, SENSOR_TYPES, RangeQuery, profiles
from ..operators import (
    anomalies,
    average,
    average_in_range,
    avg_window,
    avg_zone_type,
    bounds_violations,
    count_for_sensor,
    daily_pattern,
    daily_zone_rollup,
    floor_of_zone,
    floor_stats,
    hourly_rollup,
    in_range,
    keep_last,
    latest_by_type,
    latest_single,
    latest_zone,
    prune,
    prune_by_profile,
    sensor_ids,
    sensors_by_floor,
    sensors_by_zone,
    silent_sensors,
    spatial_radius,
    threshold_breach,
    total_count,
    type_stats,
    value_at,
    zone_hierarchy,
)
from ..sources import events
from ..storage import scratch_path
from ..synth import generate

Query = Callable[[SparkSession, str], DataFrame]

# Arguments of the registered queries.
SENSOR, ZONE, FLOOR, TYPE = 0, 0, 0, "temperature"
CENTER, RADIUS = (22.5, 0.0, 0.0), 25.0
K, THRESHOLD, MIN_DURATION_MS = 1.0, 9.5, HOUR_MS
BREACH_ALL = 50.0
WEEK_HOURS = 168
RANGE = RangeQuery(1_704_500_000_000, 1_705_500_000_000)
CUTOFF_MS = 1_705_500_000_000
RING = 20

#: Added before means are rounded: sums in another order differ in their last bits, and a mean halfway between two results must not depend on that.
NUDGE = 3.7e-10

QUERIES: dict[str, Query] = {}


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.round(F.col(c) + F.lit(NUDGE), 6).alias(c) if c in columns else F.col(c) for c in df.columns])


def query(name: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return register


def _r(spark: SparkSession, d: str, **options) -> DataFrame:
    return events.readings(spark, d, **options)


def _typed(spark: SparkSession, d: str) -> DataFrame:
    return events.readings(spark, d, sensor_type=TYPE)


@query("latest_single")
def q_latest_single(spark: SparkSession, d: str) -> DataFrame:
    return latest_single(_r(spark, d), SENSOR)


@query("latest_all")
def q_latest_all(spark: SparkSession, d: str) -> DataFrame:
    return latest_single(_r(spark, d))


@query("latest_zone")
def q_latest_zone(spark: SparkSession, d: str) -> DataFrame:
    return latest_zone(_r(spark, d), events.sensor_zone(spark, d), ZONE)


@query("latest_by_type")
def q_latest_by_type(spark: SparkSession, d: str) -> DataFrame:
    return latest_by_type(_typed(spark, d), TYPE)


@query("avg_window")
def q_avg_window(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(avg_window(_r(spark, d), 24, SENSOR), "avg_value")


@query("avg_window_week")
def q_avg_window_week(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(avg_window(_r(spark, d), WEEK_HOURS, SENSOR), "avg_value")


@query("avg_window_all")
def q_avg_window_all(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(avg_window(_r(spark, d), WEEK_HOURS), "avg_value")


@query("avg_window_unknown")
def q_avg_window_unknown(spark: SparkSession, d: str) -> DataFrame:
    return avg_window(_r(spark, d), 24, -1)


@query("avg_zone_type")
def q_avg_zone_type(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(avg_zone_type(_typed(spark, d), events.sensor_zone(spark, d), 24, ZONE, TYPE), "avg_value")


@query("avg_zone_type_week")
def q_avg_zone_type_week(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(avg_zone_type(_typed(spark, d), events.sensor_zone(spark, d), WEEK_HOURS, ZONE, TYPE), "avg_value")


@query("avg_zone_type_all")
def q_avg_zone_type_all(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(avg_zone_type(_r(spark, d), events.sensor_zone(spark, d), WEEK_HOURS), "avg_value")


@query("floor_stats")
def q_floor_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(floor_stats(_typed(spark, d), events.sensor_zone(spark, d), events.zone_floor(spark, d), 24, FLOOR, TYPE), "avg_value")


@query("floor_stats_all")
def q_floor_stats_all(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(floor_stats(_r(spark, d), events.sensor_zone(spark, d), events.zone_floor(spark, d), WEEK_HOURS), "avg_value")


@query("hourly_rollup")
def q_hourly_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(hourly_rollup(_r(spark, d), 2, SENSOR), "avg_value")


@query("hourly_rollup_all")
def q_hourly_rollup_all(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(hourly_rollup(_r(spark, d), 7), "avg_value")


@query("daily_zone_rollup")
def q_daily_zone_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(daily_zone_rollup(_typed(spark, d), events.sensor_zone(spark, d), ZONE, TYPE), "avg_value")


@query("daily_zone_rollup_all")
def q_daily_zone_rollup_all(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(daily_zone_rollup(_r(spark, d), events.sensor_zone(spark, d)), "avg_value")


@query("spatial_radius")
def q_spatial_radius(spark: SparkSession, d: str) -> DataFrame:
    return spatial_radius(_r(spark, d), CENTER, RADIUS)


def _hierarchy(depth: int) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return zone_hierarchy(_r(spark, d), events.sensor_zone(spark, d), events.zone_floor(spark, d), ZONE, depth)

    return run


for _depth in (0, 1, 2):
    QUERIES[f"zone_hierarchy_d{_depth}"] = _hierarchy(_depth)


@query("anomalies")
def q_anomalies(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(anomalies(_typed(spark, d), K, TYPE).drop("sensor_type"), "z_score")


@query("anomalies_all_types")
def q_anomalies_all_types(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(anomalies(_r(spark, d), K), "z_score")


@query("threshold_breach")
def q_threshold_breach(spark: SparkSession, d: str) -> DataFrame:
    return threshold_breach(_r(spark, d), THRESHOLD, MIN_DURATION_MS, SENSOR)


@query("threshold_breach_all")
def q_threshold_breach_all(spark: SparkSession, d: str) -> DataFrame:
    return threshold_breach(_r(spark, d), BREACH_ALL, MIN_DURATION_MS)


@query("total_count")
def q_total_count(spark: SparkSession, d: str) -> DataFrame:
    return total_count(_r(spark, d))


@query("average_value")
def q_average_value(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(average(_r(spark, d)), "avg_value")


@query("all_readings")
def q_all_readings(spark: SparkSession, d: str) -> DataFrame:
    return _r(spark, d)


@query("range_scan")
def q_range_scan(spark: SparkSession, d: str) -> DataFrame:
    return in_range(_r(spark, d), RANGE).orderBy("ts_ms", "sensor_id")


@query("range_scan_inverted")
def q_range_scan_inverted(spark: SparkSession, d: str) -> DataFrame:
    return in_range(_r(spark, d), RangeQuery(RANGE.end, RANGE.start))


@query("range_avg")
def q_range_avg(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(average_in_range(_r(spark, d), RANGE), "avg_value")


@query("range_count_sensor")
def q_range_count_sensor(spark: SparkSession, d: str) -> DataFrame:
    return count_for_sensor(_r(spark, d), SENSOR, RANGE)


@query("all_sensor_ids")
def q_all_sensor_ids(spark: SparkSession, d: str) -> DataFrame:
    return sensor_ids(_r(spark, d))


@query("readings_for_sensor")
def q_readings_for_sensor(spark: SparkSession, d: str) -> DataFrame:
    return _r(spark, d).filter(F.col("sensor_id") == SENSOR)


@query("readings_for_type")
def q_readings_for_type(spark: SparkSession, d: str) -> DataFrame:
    return _typed(spark, d)


@query("type_stats")
def q_type_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(type_stats(_r(spark, d)), "mean_value", "std_dev")


@query("sensors_by_zone")
def q_sensors_by_zone(spark: SparkSession, d: str) -> DataFrame:
    return sensors_by_zone(events.sensor_zone(spark, d), 1)


@query("sensors_by_floor")
def q_sensors_by_floor(spark: SparkSession, d: str) -> DataFrame:
    return sensors_by_floor(events.sensor_zone(spark, d), events.zone_floor(spark, d), 1)


@query("floor_of_zone")
def q_floor_of_zone(spark: SparkSession, d: str) -> DataFrame:
    return floor_of_zone(events.zone_floor(spark, d))


@query("silent_sensors")
def q_silent_sensors(spark: SparkSession, d: str) -> DataFrame:
    late = in_range(_r(spark, d), RangeQuery(1_706_600_000_000, 1_800_000_000_000))
    return silent_sensors(events.sensor_zone(spark, d), late)


@query("prune_type")
def q_prune_type(spark: SparkSession, d: str) -> DataFrame:
    return prune(_r(spark, d), TYPE, CUTOFF_MS)


@query("prune_retention")
def q_prune_retention(spark: SparkSession, d: str) -> DataFrame:
    short = profiles(spark).withColumn("retention_days", F.lit(20) * F.when(F.col("sensor_type") == "co2", 0).otherwise(1))
    return prune_by_profile(_r(spark, d), short).groupBy("sensor_type").agg(F.count("*").alias("n"), F.min("ts_ms").alias("oldest_ms"))


@query("ring_last_n")
def q_ring_last_n(spark: SparkSession, d: str) -> DataFrame:
    return keep_last(_r(spark, d, with_arrival=True), RING)


@query("bounds_violations")
def q_bounds_violations(spark: SparkSession, d: str) -> DataFrame:
    return bounds_violations(_r(spark, d), profiles(spark))


@query("daily_pattern")
def q_daily_pattern(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(daily_pattern(_r(spark, d), profiles(spark)), "peak_avg", "trough_avg")


RECOMMEND_RUNS = [("s", "q1", "A", 10.0), ("s", "q1", "B", 20.0), ("s", "q2", "A", 40.0), ("s", "q2", "B", 10.0), ("s", "q3", "A", 5.0)]
RECOMMEND_MIX = [("q1", 3.0), ("q2", 1.0), ("q3", 2.0), ("q1", 1.0)]


@query("recommend_scores")
def q_recommend_scores(spark: SparkSession, d: str) -> DataFrame:
    runs = spark.createDataFrame(RECOMMEND_RUNS, "scale string, query string, layout string, median_ns double")
    mix = spark.createDataFrame(RECOMMEND_MIX, "query string, weight double")
    return _rounded(recommend(runs, mix, "s"), "score", "coverage")


@query("value_at")
def q_value_at(spark: SparkSession, d: str) -> DataFrame:
    return value_at(_r(spark, d), RANGE.start)


def _model(spark: SparkSession) -> resolve.Building:
    """A generated building, written and read back through the shared folder."""
    path = scratch_path(spark, "building")
    text = "\n".join(write.lines(blocks=BLOCKS, floors=FLOORS, rooms=ROOMS))
    spark.range(1).select(F.lit(text).alias("value")).write.text(path)
    return resolve.resolve(source.entities(spark, f"{path}/part-*"))


#: Size of the building that the queries below are about; they read no table but that building's file.
BLOCKS, FLOORS, ROOMS = 2, 3, 4


@query("ifc_elements")
def q_ifc_elements(spark: SparkSession, d: str) -> DataFrame:
    return _model(spark).elements.drop("file")


@query("placed_sensors")
def q_placed_sensors(spark: SparkSession, d: str) -> DataFrame:
    building = _model(spark)
    placed = place.place(building.elements, building.zones)
    return placed.sensors.join(placed.locations, ["file", "sensor_id"]).drop("file")


@query("building_zones")
def q_building_zones(spark: SparkSession, d: str) -> DataFrame:
    building = _model(spark)
    return building.zones.join(building.zone_floor, ["file", "zone_id"]).drop("file")


@query("building_equipment")
def q_building_equipment(spark: SparkSession, d: str) -> DataFrame:
    return _model(spark).equipment.drop("file")


WINNER_RUNS = [("s", "latest_single", "RingBuffer", 5.0), ("s", "latest_single", "Columnar", 7.0), ("s", "avg_window", "Hierarchical", 3.0), ("s", "avg_window", "TimeSeries", 4.0), ("s", "avg_window", "Columnar", 9.0), ("s", "latest_by_type", "Columnar", 2.0), ("t", "latest_by_type", "TimeSeries", 2.0), ("t", "latest_by_type", "Columnar", 2.0)]


@query("winners")
def q_winners(spark: SparkSession, d: str) -> DataFrame:
    """Of fixed runs."""
    return winners(spark.createDataFrame(WINNER_RUNS, "scale string, query string, layout string, median_ns double"))


def _layout(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        """Readings inserted in two batches and pruned, then read by an object that finds the layout at its path."""
        path = scratch_path(spark, f"layout-{name}")
        rows = _r(spark, d, with_arrival=True)
        layout = LAYOUTS[name](spark, path)
        layout.register_zones(events.sensor_zone(spark, d))
        layout.register_floors(events.zone_floor(spark, d))
        early = F.col("ts_ms") < CUTOFF_MS
        layout.insert(rows.filter(early))
        layout.insert(rows.filter(~early))
        layout.prune_older_than(TYPE, RANGE.start)
        return LAYOUTS[name](spark, path).range(RANGE)

    return run


for _name in LAYOUTS:
    QUERIES[f"layout_{_name.lower()}_range"] = _layout(_name)


@query("synthetic_readings")
def q_synthetic_readings(spark: SparkSession, d: str) -> DataFrame:
    """A day of one sensor of each type."""
    sensors = spark.createDataFrame(list(enumerate(SENSOR_TYPES)), "sensor_id long, sensor_type string")
    return generate(sensors, 0, 24 * HOUR_MS)
