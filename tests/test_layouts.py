import re

import pytest

from gaugeworks.bench.recommend import recommend, winner, winners
from gaugeworks.bench.report import page, write_suite
from gaugeworks.bench.runner import SPECS, Arguments, RunRow, load, query_mix, run_suite, run_table
from gaugeworks.bench.timing import LatencyStats, summarise
from gaugeworks.layouts import LAYOUTS
from gaugeworks.model import HOUR_MS, RangeQuery
from gaugeworks.sources.fixtures import dataset

SCHEMA = "sensor_id long, ts_ms long, value double, sensor_type string"


@pytest.fixture(scope="module")
def data(spark):
    d = dataset(spark, 20, 30, scaled=True)
    return type(d)(*(t.cache() for t in d))


@pytest.fixture(scope="module")
def stores(spark, data, tmp_path_factory):
    base = tmp_path_factory.mktemp("layouts")
    return {name: load(cls(spark, str(base / name)), data) for name, cls in LAYOUTS.items()}


def plain(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("query", sorted(SPECS))
def test_layouts_agree(stores, query):
    results = {name: plain(SPECS[query](s, Arguments(sensor=3, zone=1, floor=1))) for name, s in stores.items()}
    assert all(r == results["AoS"] for r in results.values())
    assert results["AoS"] or query == "threshold_breach"


def test_contract(stores, data):
    for s in stores.values():
        assert s.count() == 600 and s.memory_used() > 0
        assert plain(s.readings()) == plain(data.readings)
        assert s.range(RangeQuery(1_000_000, 1_000_000)).count() == 20 and s.range(RangeQuery(5, 1)).count() == 0
        assert s.range(RangeQuery(1_000_000, 1_000_000 + HOUR_MS, 4)).count() == 2
        assert sorted(r.sensor_id for r in s.sensors_by_zone(1).collect()) == [5, 6, 7, 8, 9]
        assert s.sensors_by_floor(1).count() == 10 and s.floor_of_zone(3) == 1 and s.floor_of_zone(99) is None


@pytest.mark.parametrize("name", list(LAYOUTS))
def test_appends_moves_prunes_and_drops(spark, tmp_path, name):
    s = LAYOUTS[name](spark, str(tmp_path / "t"))
    assert s.count() == 0 and s.latest(1).collect() == [] and s.floor_of_zone(1) is None
    zones = lambda *v: spark.createDataFrame(list(v), "sensor_id long, zone_id long")
    s.register_zones(zones((1, 100)))
    s.insert(spark.createDataFrame([(1, 10, 1.0, "flow"), (1, 20, 2.0, "co2")], SCHEMA))
    s.insert(spark.createDataFrame([(1, 15, 3.0, "flow"), (2, 5, 4.0, "flow")], SCHEMA))
    s.register_zones(zones((1, 200)))
    assert s.sensors_by_zone(100).collect() == [] and s.sensors_by_zone(200).first().sensor_id == 1
    assert s.count() == 4 and s.latest(1).first().value == 2.0
    assert s.prune_older_than("flow", 12) == 2 and s.count() == 2
    s.vacuum()
    assert sorted(r.value for r in s.readings().collect()) == [2.0, 3.0]
    s.drop()
    assert s.count() == 0


def test_ring_keeps_the_last_by_arrival(spark, tmp_path):
    s = LAYOUTS["RingBuffer"](spark, str(tmp_path / "r"), capacity=3)
    s.insert(spark.createDataFrame([(1, t, float(t), "flow", t) for t in (50, 40, 30)], f"{SCHEMA}, arrival long"))
    s.insert(spark.createDataFrame([(1, 10, 10.0, "flow", 60), (1, 20, 20.0, "flow", 61)], f"{SCHEMA}, arrival long"))
    assert sorted(r.ts_ms for r in s.readings().collect()) == [10, 20, 50]
    assert s.latest(1).first().ts_ms == 50


def test_pruning_of_folders(stores):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    typed = plan(SPECS["anomalies"](stores["Columnar"], Arguments()))
    assert re.search(r"PartitionFilters: \[[^]]*isnotnull\(sensor_type", typed)
    assert re.search(r"PartitionFilters: \[[^]]*isnotnull\(zone_id", plan(stores["Hierarchical"].zone_readings(1)))


@pytest.mark.parametrize("name", list(LAYOUTS))
def test_a_layout_outlives_its_object(spark, tmp_path, name):
    path = str(tmp_path / "t")
    first = LAYOUTS[name](spark, path)
    first.insert(spark.createDataFrame([(1, t, float(t), "flow") for t in range(10)], SCHEMA))
    assert first.prune_older_than("flow", 4) == 4
    again = LAYOUTS[name](spark, path)
    assert again.count() == 6 and again.version == 1
    again.insert(spark.createDataFrame([(1, 50, 5.0, "flow")], SCHEMA))
    third = LAYOUTS[name](spark, path)
    assert third.count() == 7 and third.prune_older_than("flow", 9) == 5 and LAYOUTS[name](spark, path).count() == 2


def test_a_source_is_inserted_once_and_failed_writes_leave_nothing(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(1, 1, 1.0, "flow")], SCHEMA)
    s = LAYOUTS["Columnar"](spark, str(tmp_path / "t"))
    s.insert(rows, source="a.1")
    s.insert(rows, source="a.1")
    LAYOUTS["Columnar"](spark, str(tmp_path / "t")).insert(rows, source="a.1")
    assert LAYOUTS["Columnar"](spark, str(tmp_path / "t")).count() == 1
    monkeypatch.setattr(s, "_commit", lambda source=None: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        s.insert(rows, source="a.2")
    s = LAYOUTS["Columnar"](spark, str(tmp_path / "t"))
    assert s.count() == 1
    s.insert(rows, source="a.2")
    assert s.count() == 2


def test_arrival_over_many_partitions(spark, tmp_path):
    ring = LAYOUTS["RingBuffer"](spark, str(tmp_path / "r"), capacity=5, compact=2)
    for n in range(4):
        part = spark.range(0, 400, 1, 200).selectExpr("7L as sensor_id", f"id + {n * 1000}L as ts_ms", "cast(id as double) as value", "'flow' as sensor_type")
        ring.insert(part)
        assert sorted(r.ts_ms for r in ring.readings().collect()) == [n * 1000 + k for k in range(395, 400)]
    assert ring.version >= 1  # rewritten now and then, not at every insert
    assert ring.inserts == 4 and ring.version < 4


def test_percentiles_by_rank():
    s = summarise(list(range(100, 0, -1)))
    assert (s.median_ns, s.p95_ns, s.p99_ns, s.min_ns, s.max_ns, s.mean_ns) == (51, 96, 100, 1, 100, 50)
    assert summarise([7]).p99_ns == 7 and LatencyStats(1, 0, 0, 0, 0, 0, 0, 0).throughput == 0.0 and summarise([10**9, 10**9]).throughput == 1.0


def test_recommendation(spark):
    runs = spark.createDataFrame([("s", "a", "X", 10.0), ("s", "a", "Y", 20.0), ("s", "b", "X", 40.0), ("s", "b", "Y", 10.0)], "scale string, query string, layout string, median_ns double")
    mix = lambda *w: spark.createDataFrame(list(w), "query string, weight double")
    assert winner(recommend(runs, mix(("a", 10.0), ("b", 1.0)), "s")) == "X" and winner(recommend(runs, mix(("a", 1.0), ("b", 10.0)), "s")) == "Y"
    half = {r.layout: r.coverage for r in recommend(runs.filter("not (query = 'b' and layout = 'X')"), mix(("a", 1.0), ("b", 1.0)), "s").collect()}
    assert half == {"X": 0.5, "Y": 1.0}
    assert winner(recommend(runs, mix(("a", 1.0)), "other")) == "none"
    twice = recommend(runs, mix(("a", 1.0), ("a", 1.0)), "s").collect()
    assert {r.layout: r.score for r in twice} == {"X": 1.0, "Y": 2.0}


def test_suite_reports(spark, tmp_path):
    rows = run_suite(spark, str(tmp_path / "t"), tiers=[("Tiny", 10, 5, 1)], layouts=["TimeSeries", "RingBuffer"], queries=("latest_single", "hourly_rollup"), iterations=1)
    assert [(r.query, r.layout) for r in rows] == [("latest_single", "TimeSeries"), ("hourly_rollup", "TimeSeries"), ("latest_single", "RingBuffer")]
    write_suite(str(tmp_path / "out"), rows, winners(run_table(spark, rows)).collect())
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"latency.md", "latency.json", "benchmark.html"}
    assert "RingBuffer" in (tmp_path / "out" / "latency.md").read_text()


def test_query_mix(spark):
    mix = query_mix(spark.createDataFrame([(0, "flow"), (1, "flow"), (2, "vibration")], "sensor_id long, sensor_type string"))
    assert mix.count() == 4 + 5


def test_page_has_a_tab_a_scale():
    rows = [RunRow(scale, "avg_window", layout, 10, summarise([t])) for scale in ("small", "<large>") for layout, t in (("aos", 1000), ("soa", 4000))]
    text = page(rows)
    assert text.count("type=radio") == text.count("<section id=scale") == 2 and text.count(" checked>") == 1
    assert "#tab1:checked~#scale1" in text and "<h2>&lt;large&gt;</h2>" in text and "width:25%" in text
    assert "type=radio" not in page([])
