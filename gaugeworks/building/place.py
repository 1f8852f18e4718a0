"""Sensors for a building's elements, by rule."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import placed_count
from ..model import DEFAULT_AREA_M2, PLACEMENT_RULES, profiles


class Placement(NamedTuple):
    sensors: DataFrame
    locations: DataFrame


def place(elements: DataFrame, zones: DataFrame, rules: Mapping[str, Sequence[str]] = PLACEMENT_RULES, default_area: float = DEFAULT_AREA_M2) -> Placement:
    """Every element gets its rule's types, as many of each as its area and the type's density ask for.

    Sensors are numbered densely by element, type and copy. An element's zone is
    itself if it is one, else its parent if that is one, else 0.
    """
    spark = elements.sparkSession
    kinds = F.create_map(*[x for k, types in rules.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in types]))]) if rules else F.lit(None).cast("map<string,array<string>>")
    density = profiles(spark).select("sensor_type", "density", (F.lit(1000.0) / F.col("period_ms")).alias("frequency_hz"))
    areas = zones.select("file", F.col("zone_id").alias("ifc_id"), "area_m2", F.lit(True).alias("is_zone"))
    known = zones.select("file", F.col("zone_id").alias("parent_id"), F.lit(True).alias("in_zone"))
    rows = elements.select("*", F.posexplode(kinds[F.col("element_type")]).alias("type_place", "sensor_type"))
    rows = rows.join(areas, ["file", "ifc_id"], "left").join(known, ["file", "parent_id"], "left").join(F.broadcast(density), "sensor_type")
    area = F.when(F.col("area_m2") > 0, F.col("area_m2")).otherwise(default_area)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), placed_count(area, F.col("density")))))
    # dense numbers need one order of all sensors; this is a few rows an element
    order = Window.partitionBy("file").orderBy("ifc_id", "type_place", "copy")
    rows = rows.withColumn("sensor_id", (F.row_number().over(order) - 1).cast("long"))
    zone = F.when(F.col("is_zone"), F.col("ifc_id")).when(F.col("in_zone"), F.col("parent_id")).otherwise(0)
    return Placement(
        rows.select("file", "sensor_id", "sensor_type", "frequency_hz", F.col("ifc_id").alias("element_id")),
        rows.select("file", "sensor_id", zone.cast("long").alias("zone_id"), "x", "y", "z"),
    )
