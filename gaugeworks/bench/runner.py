"""The suite over tiers of fixture data, and the run over a building's own sensors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..layouts import BENCHMARKED, LAYOUTS, Hierarchical, Layout
from ..model import FAMILIES, HOUR_MS, PROFILE, QUERY_MIX, TIERS, TYPED_QUERIES
from ..operators import anomalies, avg_window, avg_zone_type, daily_zone_rollup, floor_stats, hourly_rollup, latest_by_type, latest_zone, spatial_radius, threshold_breach, zone_hierarchy
from ..sources.fixtures import Dataset, dataset
from .timing import LatencyStats, time_query

#: Sensors of a type that a building's run cycles through.
SAMPLE = 25


@dataclass(frozen=True)
class Arguments:
    """What the twelve queries ask about."""

    sensor: int = 0
    zone: int = 0
    floor: int = 0
    sensor_type: str = "temperature"
    hours: int = 24
    days: int = 2
    center: tuple[float, float, float] = (22.5, 0.0, 0.0)
    radius: float = 25.0
    depth: int = 1
    k: float = 1.0
    threshold: float = 9.5
    min_duration_ms: int = HOUR_MS


@dataclass(frozen=True)
class RunRow:
    scale: str
    query: str
    layout: str
    memory_bytes: int
    stats: LatencyStats


def _zone_rows(layout: Layout, zone: int) -> DataFrame:
    return layout.zone_readings(zone) if isinstance(layout, Hierarchical) else layout.readings()


SPECS: dict[str, Callable[[Layout, Arguments], DataFrame]] = {
    "avg_window": lambda s, a: avg_window(s.readings(), a.hours, a.sensor),
    "latest_single": lambda s, a: s.latest(a.sensor),
    "latest_zone": lambda s, a: latest_zone(_zone_rows(s, a.zone), s.sensor_zone(), a.zone),
    "latest_by_type": lambda s, a: latest_by_type(s.readings(), a.sensor_type),
    "avg_zone_type": lambda s, a: avg_zone_type(_zone_rows(s, a.zone), s.sensor_zone(), a.hours, a.zone, a.sensor_type),
    "floor_stats": lambda s, a: floor_stats(s.readings(), s.sensor_zone(), s.zone_floor(), a.hours, a.floor, a.sensor_type),
    "spatial_radius": lambda s, a: spatial_radius(s.readings(), a.center, a.radius),
    "zone_hierarchy": lambda s, a: zone_hierarchy(s.readings(), s.sensor_zone(), s.zone_floor(), a.zone, a.depth),
    "anomalies": lambda s, a: anomalies(s.readings(), a.k, a.sensor_type),
    "threshold_breach": lambda s, a: threshold_breach(s.readings(), a.threshold, a.min_duration_ms, a.sensor),
    "hourly_rollup": lambda s, a: hourly_rollup(s.readings(), a.days, a.sensor),
    "daily_zone_rollup": lambda s, a: daily_zone_rollup(_zone_rows(s, a.zone), s.sensor_zone(), a.zone, a.sensor_type),
}


def load(layout: Layout, data: Dataset) -> Layout:
    layout.register_zones(data.sensor_zone)
    layout.register_floors(data.zone_floor)
    layout.insert(data.readings)
    return layout


def run_suite(spark: SparkSession, path: str, tiers=TIERS, layouts=BENCHMARKED, queries=tuple(SPECS), arguments: Arguments = Arguments(), iterations: int | None = None) -> list[RunRow]:  # noqa: B008
    """Every tier, query and layout on a fresh table."""
    rows = []
    for scale, sensors, per_sensor, runs in tiers:
        data = dataset(spark, sensors, per_sensor, scaled=True)
        for name in layouts:
            for query in queries:
                if query in LAYOUTS[name].excluded:
                    continue
                layout = load(LAYOUTS[name](spark, f"{path}/{scale}-{name}-{query}"), data)
                stats = time_query(lambda _, s=layout, q=query: SPECS[q](s, arguments), iterations or runs)
                rows.append(RunRow(scale, query, name, layout.memory_used(), stats))
                layout.drop()
    return rows


def query_mix(sensors: DataFrame) -> DataFrame:
    """query, weight: the workloads of all types that were placed, one after the other."""
    spark = sensors.sparkSession
    mix = spark.createDataFrame([(t, q, float(w)) for t, own in QUERY_MIX.items() for q, w in own.items()], "sensor_type string, query string, weight double")
    return mix.join(sensors.select("sensor_type").distinct(), "sensor_type", "left_semi").select("sensor_type", "query", "weight")


def sample_sensors(locations: DataFrame, sensors: DataFrame, cap: int = SAMPLE) -> dict[str, list[Arguments]]:
    """By type, arguments for its first sensors; bounded by types times cap."""
    order = Window.partitionBy("sensor_type").orderBy("sensor_id")
    rows = sensors.join(locations, ["file", "sensor_id"]).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap)
    out: dict[str, list[Arguments]] = {}
    for r in rows.orderBy("sensor_type", "rank").collect():
        own = Arguments(sensor=r.sensor_id, zone=r.zone_id, floor=r.zone_id, sensor_type=r.sensor_type, center=(r.x, r.y, r.z), radius=50.0, depth=2, threshold=PROFILE[r.sensor_type].base)
        out.setdefault(r.sensor_type, []).append(own)
    return out


def run_building(spark: SparkSession, path: str, label: str, data: Dataset, samples: dict[str, list[Arguments]], layouts=BENCHMARKED, iterations: int = 25) -> tuple[list[RunRow], dict[str, list[RunRow]]]:
    """Latencies of the building's queries over its first sensors, and by type of its typed queries. One table a layout; runs cycle through the samples."""
    floors = {r.zone_id: r.floor_id for r in data.zone_floor.collect()}
    everyone = [a for own in samples.values() for a in own][:SAMPLE]
    asked = sorted({q for t in samples for q in QUERY_MIX[t]}, key=list(FAMILIES).index)
    rows, by_type = [], {t: [] for t in samples}
    for name in layouts:
        layout = load(LAYOUTS[name](spark, f"{path}/{label}-{name}"), data)
        size = layout.memory_used()

        def timed(query: str, cycle: list[Arguments], s: Layout = layout) -> LatencyStats:
            cycle = [Arguments(**{**asdict(a), "floor": floors.get(a.zone, a.zone)}) for a in cycle]
            return time_query(lambda i: SPECS[query](s, cycle[i % len(cycle)]), iterations)

        for query in asked:
            if query not in layout.excluded:
                rows.append(RunRow(label, query, name, size, timed(query, everyone)))
        for t, own in samples.items():
            for query in QUERY_MIX[t]:
                if query in TYPED_QUERIES and query not in layout.excluded:
                    by_type[t].append(RunRow(label, query, name, size, timed(query, own)))
        layout.drop()
    return rows, by_type


def run_table(spark: SparkSession, rows: list[RunRow]) -> DataFrame:
    schema = "scale string, query string, layout string, memory_bytes long, median_ns double, p95_ns double, p99_ns double"
    return spark.createDataFrame([(r.scale, r.query, r.layout, r.memory_bytes, float(r.stats.median_ns), float(r.stats.p95_ns), float(r.stats.p99_ns)) for r in rows], schema)
