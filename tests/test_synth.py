import pytest
from pyspark.sql import functions as F

from gaugeworks.functions.codec import decode_deltas, encode_deltas, leb128, unzigzag, zigzag
from gaugeworks.model import DAY_MS, HOUR_MS, PROFILES, SENSOR_TYPES, profiles
from gaugeworks.operators import bounds_violations, daily_pattern
from gaugeworks.synth import generate


def sensors(spark, *types):
    return spark.createDataFrame(list(enumerate(types)), "sensor_id long, sensor_type string")


def test_samples_an_hour(spark):
    got = {r.sensor_type: r["count"] for r in generate(sensors(spark, *SENSOR_TYPES), 0, HOUR_MS).groupBy("sensor_type").count().collect()}
    assert got == {"temperature": 13, "humidity": 13, "occupancy": 61, "co2": 21, "vibration": 31, "flow": 61, "energy": 5, "structural": 7, "air_quality": 21}


def test_deterministic_and_seeded(spark):
    own = sensors(spark, *SENSOR_TYPES)
    a, b, c = (sorted(map(tuple, generate(own.repartition(n), 0, DAY_MS // 4, seed).collect())) for n, seed in ((1, 42), (7, 42), (1, 43)))
    assert a == b != c


def test_bounds_and_daily_pattern(spark):
    r = generate(sensors(spark, *SENSOR_TYPES), 0, 3 * DAY_MS).cache()
    assert bounds_violations(r, profiles(spark)).count() == 0
    found = {x.sensor_type: x.has_pattern for x in daily_pattern(r, profiles(spark)).collect()}
    assert all(found[p.sensor_type] for p in PROFILES if p.shape in ("diurnal", "binary", "stepwise"))


def test_occupancy_dwells(spark):
    values = [r.value for r in generate(sensors(spark, "occupancy"), 0, 2 * DAY_MS).orderBy("ts_ms").collect()]
    assert set(values) == {0.0, 1.0}
    assert sum(a == b for a, b in zip(values, values[1:], strict=False)) / len(values) > 0.6


def test_vibration_bursts(spark):
    r = generate(sensors(spark, "vibration"), 0, 7 * DAY_MS)
    share = r.agg(F.avg((F.col("value") > 0.3).cast("double"))).first()[0]
    assert 0 < share < 0.2


def test_levels_hold(spark):
    r = [x.value for x in generate(sensors(spark, "energy"), 0, 4 * DAY_MS).orderBy("ts_ms").collect()]
    assert len(r) == len(set(range(len(r)))) and sum(abs(a - b) < 0.8 for a, b in zip(r, r[1:], strict=False)) > 0.6 * len(r)


def test_many_sensors(spark):
    many = spark.range(100_000).select(F.col("id").alias("sensor_id"), F.lit("temperature").alias("sensor_type"))
    assert generate(many, 0, 2000).count() == 100_000


def test_empty_range(spark):
    assert generate(sensors(spark, *SENSOR_TYPES), 10, 10).count() == 0


@pytest.mark.parametrize("times", [[], [0], [5, 3, -7], [10**12 + i * HOUR_MS for i in range(100)], [-(2**62), 2**62]])
def test_codec(times):
    assert decode_deltas(encode_deltas(times)) == times
    assert all(unzigzag(zigzag(t)) == t for t in times) and leb128(300) == b"\xac\x02"
