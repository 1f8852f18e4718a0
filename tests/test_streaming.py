from gaugeworks.layouts import LAYOUTS
from gaugeworks.model import HOUR_MS
from gaugeworks.operators import hourly_rollup, latest_single, threshold_breach
from gaugeworks.streaming import daily, first_breach, hourly, latest, ring, sink

SCHEMA = "sensor_id long, ts_ms long, value double, sensor_type string"


def batches(spark, tmp_path, *parts):
    """A stream that reads one part a batch."""
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{n:03}"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def run(df, mode, name, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


PARTS = [[(1, t * HOUR_MS // 2, float(t % 7 * 10), "flow") for t in range(a, a + 20)] + [(2, t * HOUR_MS, 1.0, "co2") for t in range(a, a + 3)] for a in (0, 20, 40)]


def test_latest_and_hourly(spark, tmp_path):
    stream = batches(spark, tmp_path, *PARTS)
    everything = spark.createDataFrame([r for p in PARTS for r in p], SCHEMA)
    assert sorted(map(tuple, run(latest(stream), "complete", "latest_now", tmp_path).collect())) == sorted(map(tuple, latest_single(everything).collect()))
    closed = {(r.sensor_id, r.bucket_ms): r.avg_value for r in run(hourly(stream, "100 hours"), "append", "hours", tmp_path).collect()}
    whole = {(r.sensor_id, r.bucket_ms): r.avg_value for r in hourly_rollup(everything, 100).collect()}
    assert all(whole[k] == v for k, v in closed.items())
    updated = run(hourly(stream, "100 hours"), "complete", "hours_all", tmp_path)
    assert {(r.sensor_id, r.bucket_ms): r.avg_value for r in updated.collect()} == whole


def test_breach_across_batches(spark, tmp_path):
    parts = [[(7, 0, 100.0, "flow"), (7, 10, 5.0, "flow"), (7, 100, 100.0, "flow")], [(7, 200, 110.0, "flow"), (7, 300, 105.0, "flow"), (7, 400, 5.0, "flow")]]
    got = run(first_breach(batches(spark, tmp_path, *parts), 50, 150), "append", "breaches", tmp_path).collect()
    assert [(r.sensor_id, r.start_ts, r.end_ts) for r in got] == [(7, 100, 300)]
    whole = threshold_breach(spark.createDataFrame(parts[0] + parts[1], SCHEMA), 50, 150).first()
    assert (whole.start_ts, whole.end_ts, whole.peak_value) == (got[0].start_ts, got[0].end_ts, got[0].peak_value)


def test_ring(spark, tmp_path):
    parts = [[(1, t, float(t), "flow") for t in range(a, a + 4)] for a in (0, 4, 8)]
    got = run(ring(batches(spark, tmp_path, *parts), 5), "update", "rings", tmp_path).collect()
    assert max(got, key=lambda r: r.ts_ms[-1]).ts_ms == [7, 8, 9, 10, 11] and all(len(r.ts_ms) <= 5 for r in got)


def test_sink(spark, tmp_path):
    layout = LAYOUTS["TimeSeries"](spark, str(tmp_path / "table"))
    q = sink(batches(spark, tmp_path, *PARTS), layout, str(tmp_path / "sink"))
    q.processAllAvailable()
    q.stop()
    assert layout.count() == sum(map(len, PARTS))


def test_breach_is_told_with_its_true_end_and_peak(spark, tmp_path):
    parts = [[(7, 1000, 100.0, "flow"), (7, 1200, 101.0, "flow")], [(7, 1300, 500.0, "flow"), (7, 1100, 1.0, "flow")], [(7, 1900, 90.0, "flow")], [(8, 50_000_000, 1.0, "flow")], [(8, 90_000_000, 1.0, "flow")], [(8, 90_000_001, 1.0, "flow")]]
    got = run(first_breach(batches(spark, tmp_path, *parts), 50, 150, "10 seconds"), "append", "open_breach", tmp_path).collect()
    # the late reading at 1100 changes nothing, and none ends the run: it is over once the watermark has left it behind
    assert [tuple(r) for r in got] == [(7, 1000, 1900, 900, 500.0)]


def test_days(spark, tmp_path):
    day = 24 * HOUR_MS
    parts = [[(1, 5, 1.0, "flow"), (1, day - 1, 3.0, "flow"), (2, day, 7.0, "co2")], [(1, day + 5, 9.0, "flow")]]
    got = run(daily(batches(spark, tmp_path, *parts), "1 hour", ("sensor_id", "sensor_type")), "complete", "days", tmp_path).collect()
    assert sorted((r.sensor_id, r.sensor_type, r.bucket_ms, r.avg_value, r.n) for r in got) == [(1, "flow", 0, 2.0, 2), (1, "flow", day, 9.0, 1), (2, "co2", day, 7.0, 1)]


def test_sink_replays_and_retention(spark, tmp_path):
    day = 24 * HOUR_MS
    layout = LAYOUTS["Columnar"](spark, str(tmp_path / "kept"))
    parts = [[(1, 0, 1.0, "flow"), (1, 0, 2.0, "co2")], [(1, 5 * day, 3.0, "flow"), (1, 5 * day, 4.0, "co2")]]
    stream = batches(spark, tmp_path, *parts)
    for _ in range(2):  # the second run starts from a checkpoint without the last batch's commit
        q = sink(stream, layout, str(tmp_path / "sink2"), {"flow": 2})
        q.processAllAvailable()
        q.stop()
        (tmp_path / "sink2/commits/1").unlink()
        (tmp_path / "sink2/commits/.1.crc").unlink(missing_ok=True)
    assert sorted(r.value for r in layout.readings().collect()) == [2.0, 3.0, 4.0]
