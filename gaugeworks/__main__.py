"""``python -m gaugeworks --bim FILE``: place sensors in a building, time the layouts on their readings, recommend one.

Without a building the suite runs over the fixture tiers.
"""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import functions as F

from .bench.recommend import recommend, winners
from .bench.report import recommendation, write_suite
from .bench.runner import query_mix, run_building, run_suite, run_table, sample_sensors
from .bench.schematic import points, svg
from .building import place as placing
from .building import resolve, source
from .model import DAY_MS
from .session import session
from .sources.fixtures import Dataset
from .storage import shared_dir
from .synth import generate


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="gaugeworks", description=__doc__)
    parser.add_argument("--bim", help="building file to place sensors in")
    parser.add_argument("--out", default="benchmark-results", help="folder for the reports")
    parser.add_argument("--hours", type=int, default=24, help="hours of readings to make for a building")
    parser.add_argument("--iterations", type=int, help="timed runs of a query")
    parser.add_argument("--master", help="Spark master")
    args = parser.parse_args(argv)
    spark = session(master=args.master)
    tables = f"{shared_dir(spark)}/layouts"
    if not args.bim:
        rows = run_suite(spark, tables, iterations=args.iterations)
        write_suite(args.out, rows, winners(run_table(spark, rows)).collect())
        return
    building = resolve.resolve(source.entities(spark, args.bim))
    placed = placing.place(building.elements, building.zones)
    sensors, locations = placed.sensors.cache(), placed.locations.cache()
    data = Dataset(generate(sensors, 0, args.hours * DAY_MS // 24), locations.select("sensor_id", "zone_id"), building.zone_floor.select("zone_id", "floor_id"))
    label = Path(args.bim).stem
    rows, by_type = run_building(spark, tables, label, data, sample_sensors(locations, sensors), iterations=args.iterations or 25)
    mix = query_mix(sensors)
    ranked = lambda runs, weights: recommend(run_table(spark, runs), weights, label).orderBy("score", "layout").collect()
    typed = {t: ranked(runs, mix.filter(F.col("sensor_type") == t).filter(F.col("query").isin([r.query for r in runs]))) for t, runs in by_type.items() if runs}
    counts = {"elements": building.elements.count(), "zones": building.zones.count(), "equipment": building.equipment.count(), "sensors": sensors.count()}
    kinds = {r.sensor_type: r["count"] for r in sensors.groupBy("sensor_type").count().collect()}
    out = Path(args.out)
    out.mkdir(parents=True, exist_ok=True)
    (out / "recommendation.md").write_text(recommendation(args.bim, label, counts, kinds, ranked(rows, mix), rows, typed))
    (out / "schematic.svg").write_text(svg(label, points(sensors, locations, building.elements, building.zones, building.zone_floor).collect()))


if __name__ == "__main__":
    main()
