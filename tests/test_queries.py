"""Every registered query against its SQL on the smallest tables, and hand-valued cases."""

import glob
import math
import os
import random
from collections import Counter

import duckdb
import pytest

from gaugeworks import operators as op
from gaugeworks.model import HOUR_MS, RangeQuery, profiles
from gaugeworks.plans.oracles import ORACLE_SQL
from gaugeworks.plans.queries import QUERIES
from gaugeworks.sources.fixtures import dataset

DATA = "/root/testdata/sf0.001"
SCHEMA = "sensor_id long, ts_ms long, value double, sensor_type string"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(rows):
    norm = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    return Counter(tuple(norm(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, tables, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    expected = tables.sql(ORACLE_SQL[name])
    assert sorted(expected.columns) == columns
    picked = ", ".join(columns)
    assert plain(df.select(*columns).collect()) == plain(expected.project(picked).fetchall())


@pytest.fixture(scope="module")
def fixture(spark):
    data = dataset(spark)
    return type(data)(*(t.cache() for t in data))


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def ids(df):
    return sorted(r.sensor_id for r in df.collect())


def test_avg_window(spark):
    one = rows(spark, (5, 1_000_000, 42.0, "temperature"))
    assert op.avg_window(one, 24, 5).first().avg_value == 42.0
    assert op.avg_window(one, 24, 999).first().avg_value == 0.0
    assert op.avg_window(one.limit(0), 24, 5).first().avg_value == 0.0
    hourly = rows(spark, *[(1, h * HOUR_MS, float(h), "flow") for h in range(30)])
    assert op.avg_window(hourly, 24, 1).first().avg_value == sum(range(5, 30)) / 25  # both ends count


def test_latest(spark, fixture):
    assert op.latest_single(fixture.readings, 999).collect() == []
    mixed = rows(spark, (1, 10, 1.0, "co2"), (1, 20, 2.0, "flow"), (1, 20, 3.0, "flow"), (2, 5, 4.0, "co2"))
    assert op.latest_single(mixed, 1).first().value == 3.0
    assert sorted((r.sensor_id, r.value) for r in op.latest_by_type(mixed, "co2").collect()) == [(1, 1.0), (2, 4.0)]
    zone = op.latest_zone(fixture.readings, fixture.sensor_zone, 1)
    assert ids(zone) == [5, 6, 7, 8, 9] and {r.ts_ms for r in zone.collect()} == {1_000_000 + 49 * HOUR_MS}


def test_zone_and_floor(spark, fixture):
    r, z, f = fixture
    assert op.avg_zone_type(r, z, 24, 0, "co2").first().avg_value == 0.0
    assert tuple(op.floor_stats(r, z, f, 24, 999, "temperature").first()) == (0.0, 0.0, 0.0)
    low, high, mean = op.floor_stats(r, z, f, 24, 0, "temperature").first()
    assert 10 <= low < mean < high < 17


def test_spatial_radius(fixture):
    near = lambda c, r: ids(op.spatial_radius(fixture.readings, c, r))
    assert near((0, 0, 0), 0) == [0] and near((0, 0, 0), 1) == [0] and near((0, 0, 0), 6) == [0, 1]
    assert near((22.5, 0, 0), 5) == [4, 5] and near((0, 0, 0), 100) == list(range(10)) and near((999, 999, 0), 1) == []


def test_zone_hierarchy(fixture):
    tree = lambda z, d: ids(op.zone_hierarchy(*fixture, z, d))
    assert tree(0, 0) == list(range(5)) and tree(1, 0) == list(range(5, 10))
    assert tree(0, 1) == tree(1, 1) == tree(0, 2) == tree(0, 9) == list(range(10))
    assert tree(999, 0) == [] and tree(999, 1) == [] and tree(999, 2) == list(range(10))


def test_anomalies(spark):
    make = lambda *v: rows(spark, *[(1, i, x, "flow") for i, x in enumerate(v)])
    assert op.anomalies(make(1.0), 1, "flow").collect() == []
    assert op.anomalies(make(42.0, 42.0, 42.0), 1, "flow").collect() == []
    assert op.anomalies(make(*[0.1] * 1000), 0, "flow").collect() == []
    outlier = make(*[10.0] * 19, 1000.0)
    assert [r.value for r in op.anomalies(outlier, 2, "flow").collect()] == [1000.0]
    assert op.anomalies(outlier, 1000, "flow").collect() == []


def test_threshold_breach(spark):
    values = [(0, 100), (10, 5), (100, 100), (200, 110), (300, 105), (400, 5), (500, 200), (600, 250), (700, 5)]
    seven = rows(spark, *[(7, t, float(v), "energy") for t, v in values])
    assert tuple(op.threshold_breach(seven, 50, 150, 7).first()) == (7, 100, 300, 200, 110.0)
    assert op.threshold_breach(seven, 50, 0, 7).first().duration_ms == 0
    short = rows(spark, (1, 0, 99.0, "flow"), (1, 10, 99.0, "flow"), (1, 20, 1.0, "flow"))
    assert op.threshold_breach(short, 50, 1000, 1).collect() == []
    open_ = rows(spark, (1, 0, 1.0, "flow"), (1, 10, 99.0, "flow"), (1, 5000, 99.0, "flow"))
    assert op.threshold_breach(open_, 50, 1000, 1).first().end_ts == 5000


def first_breach_by_hand(readings, threshold, least):
    found = {}
    for sensor in {r[0] for r in readings}:
        run = []
        for _, ts, value, _ in [*sorted(r for r in readings if r[0] == sensor), (sensor, None, threshold, "")]:
            if value > threshold:
                run.append((ts, value))
                continue
            if run and run[-1][0] - run[0][0] >= least:
                found.setdefault(sensor, (run[0][0], run[-1][0], run[-1][0] - run[0][0], max(v for _, v in run)))
            run = []
    return {(s, *v) for s, v in found.items()}


@pytest.mark.parametrize("slice_ms", [1, 7, 50, 10_000])
def test_runs_that_slices_of_time_cut(spark, slice_ms):
    draw = random.Random(5)
    steps = [(sensor, draw.randrange(-150, 150), float(draw.random() < 0.3 + 0.09 * sensor), "flow") for sensor in range(8) for _ in range(120)]
    readings = rows(spark, *steps)
    for least in (0, 6, 25):
        assert {tuple(r) for r in op.threshold_breach(readings, 0.5, least, slice_ms=slice_ms).collect()} == first_breach_by_hand(steps, 0.5, least)


def test_rollups(spark, fixture):
    hours = op.hourly_rollup(fixture.readings, 2, 0).orderBy("bucket_ms").collect()
    assert len(hours) == 49 and all(r.n == 1 and r.bucket_ms % HOUR_MS == 0 for r in hours)
    negative = rows(spark, (1, -1, 5.0, "flow"))
    assert op.hourly_rollup(negative, 1, 1).first().bucket_ms == -HOUR_MS
    assert op.daily_zone_rollup(fixture.readings, fixture.sensor_zone, 0, "temperature").agg({"n": "sum"}).first()[0] == 150


def test_system_functions(spark):
    five = rows(spark, (1, 100, 10.0, "temperature"), (1, 300, 30.0, "temperature"), (1, 200, 20.0, "temperature"), (2, 150, 15.0, "humidity"), (2, 250, 25.0, "humidity"))
    assert op.total_count(five).first().n == 5 and op.average(five).first().avg_value == 20.0
    assert op.average_in_range(five, RangeQuery(100, 200)).first().avg_value == 15.0
    assert op.average(five.limit(0)).first().avg_value == 0.0
    assert op.in_range(five, RangeQuery(200, 100)).collect() == [] and op.in_range(five, RangeQuery(150, 150)).count() == 1
    assert op.count_for_sensor(five, 2, RangeQuery(0, 1000, sensor_id=1)).first().n == 2
    stats = {r.sensor_type: r for r in op.type_stats(five).collect()}["temperature"]
    assert stats.n == 3 and stats.mean_value == 20.0 and math.isclose(stats.std_dev, 8.16496580927726)


def test_topology(spark):
    zones = spark.createDataFrame([(1, 100, 0), (2, 100, 1), (1, 200, 2)], "sensor_id long, zone_id long, seq long")
    now = op.register(zones, "sensor_id", order="seq")
    assert ids(op.sensors_by_zone(now, 100)) == [2] and ids(op.sensors_by_zone(now, 200)) == [1]
    z = spark.createDataFrame([(1, 4291), (2, 88), (3, 50), (4, 7)], "sensor_id long, zone_id long")
    f = spark.createDataFrame([(4291, 2), (88, 2), (50, 0)], "zone_id long, floor_id long")
    assert ids(op.sensors_by_floor(z, f, 2)) == [1, 2] and ids(op.sensors_by_floor(z, f, 0)) == [3]
    assert op.floor_of_zone(f, 88).first().floor_id == 2 and op.floor_of_zone(f, 7).collect() == []


def test_retention(spark):
    ring = spark.createDataFrame([(1, t, 0.0, "flow", t) for t in range(1100)], f"{SCHEMA}, arrival long")
    kept = op.keep_last(ring)
    assert kept.count() == 1000 and kept.agg({"ts_ms": "min"}).first()[0] == 100
    late = spark.createDataFrame([(1, 50, 0.0, "flow", 2), (1, 90, 0.0, "flow", 1), (1, 70, 0.0, "flow", 0)], f"{SCHEMA}, arrival long")
    assert sorted(r.ts_ms for r in op.keep_last(late, 2).collect()) == [50, 90]
    two = rows(spark, (1, 100, 1.0, "flow"), (1, 200, 1.0, "flow"), (1, 100, 1.0, "co2"))
    assert op.prune(two, "flow", 200).count() == 2
    day = 86_400_000
    old = rows(spark, (1, 0, 1.0, "vibration"), (1, 30 * day, 1.0, "vibration"), (1, 31 * day, 1.0, "flow"), (1, 0, 1.0, "unknown"))
    assert sorted((r.sensor_type, r.ts_ms // day) for r in op.prune_by_profile(old, profiles(spark)).collect()) == [("flow", 31), ("unknown", 0), ("vibration", 30)]


def test_bounds_and_pattern(spark):
    r = rows(spark, (1, 0, 51.0, "temperature"), (1, 1, 50.0, "temperature"), (1, 2, -0.5, "humidity"))
    assert sorted(x.value for x in op.bounds_violations(r, profiles(spark)).collect()) == [-0.5, 51.0]
    shaped = rows(spark, *[(1, h * HOUR_MS, 24.0 if 13 <= h <= 17 else 18.0, "temperature") for h in range(24)])
    found = {x.sensor_type: x.has_pattern for x in op.daily_pattern(shaped, profiles(spark)).collect()}
    assert found["temperature"] and found["occupancy"] and not found["co2"]


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["latest_by_type"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "event_type" in plan.split("PushedFilters")[1] and "props" not in plan
    sensor = QUERIES["hourly_rollup"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,0)" in sensor and "Python" not in sensor


def test_session_zone_does_not_move_times(spark):
    before = QUERIES["total_count"](spark, DATA).first(), QUERIES["latest_all"](spark, DATA).agg({"ts_ms": "sum"}).first()
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert before == (QUERIES["total_count"](spark, DATA).first(), QUERIES["latest_all"](spark, DATA).agg({"ts_ms": "sum"}).first())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_queries_without_sql(spark):
    assert set(QUERIES) - set(ORACLE_SQL) == {"synthetic_readings"}
    elements = {r.element_type: r["count"] for r in QUERIES["ifc_elements"](spark, DATA).groupBy("element_type").count().collect()}
    assert elements == {"project": 1, "site": 1, "building": 2, "storey": 6, "space": 24, "wall": 24, "flow_segment": 24, "equipment": 24, "beam": 6}
    placed = QUERIES["placed_sensors"](spark, DATA).collect()
    assert len(placed) == 24 * 3 + 24 * 3 + 24 * 2 + 6 and sorted(r.sensor_id for r in placed) == list(range(len(placed)))
    assert QUERIES["synthetic_readings"](spark, DATA).count() == 289 * 2 + 1441 * 2 + 481 * 2 + 721 + 97 + 145


def test_value_at(spark):
    r = rows(spark, (1, 10, 1.0, "flow"), (1, 20, 2.0, "flow"), (2, 15, 3.0, "flow"))
    assert [(x.sensor_id, x.value) for x in op.value_at(r, 14).collect()] == [(1, 1.0)]
