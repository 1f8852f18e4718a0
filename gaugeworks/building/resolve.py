"""Entities to elements, zones, equipment and floors, by joins.

Chains of parents and of placements are followed by doubling: each round joins
a table of jumps with itself, so 64 steps take seven joins, whatever the
number of elements, and a cycle ends as a chain that is too long.

A child that both relations name belongs where it is contained; of equal ones
the relation with the largest id counts.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut

# Entity types and what they are in a building. Any other type is no element.
ELEMENT_TYPES = {
    "IFCPROJECT": "project", "IFCSITE": "site", "IFCBUILDING": "building", "IFCBUILDINGSTOREY": "storey", "IFCSPACE": "space",
    "IFCWALL": "wall", "IFCWALLSTANDARDCASE": "wall", "IFCSLAB": "slab", "IFCBEAM": "beam", "IFCFLOWSEGMENT": "flow_segment",
    "IFCFLOWTERMINAL": "equipment", "IFCFLOWFITTING": "equipment", "IFCFLOWCONTROLLER": "equipment", "IFCFLOWMOVINGDEVICE": "equipment",
    "IFCFLOWSTORAGEDEVICE": "equipment", "IFCENERGYCONVERSIONDEVICE": "equipment", "IFCDISTRIBUTIONCONTROLELEMENT": "equipment",
    "IFCBUILDINGELEMENTPROXY": "equipment", "IFCELECTRICAPPLIANCE": "equipment", "IFCALARM": "equipment",
    "IFCCABLECARRIERSEGMENT": "equipment", "IFCCABLESEGMENT": "equipment",
}
# Properties that can name a model, best first.
MODEL_PROPERTIES = ["Family and Type", "Type Name", "Family Name"]

MAX_HOPS = 64


class Building(NamedTuple):
    elements: DataFrame
    zones: DataFrame
    equipment: DataFrame
    zone_floor: DataFrame


def _arg(n: int) -> Column:
    return F.get("args", n)


def _children(entities: DataFrame, kind: str, parent: int, children: int, rank: int) -> DataFrame:
    rows = entities.filter(F.col("type") == kind).select("file", F.col("id").alias("rel"), _arg(parent)["ref"].alias("parent_id"), F.explode(_arg(children)["items"]["ref"]).alias("id"))
    return rows.filter("id is not null and parent_id is not null").withColumn("rank", F.lit(rank))


def parents(entities: DataFrame) -> DataFrame:
    """file, id, parent_id."""
    both = _children(entities, "IFCRELAGGREGATES", 4, 5, 0).unionByName(_children(entities, "IFCRELCONTAINEDINSPATIALSTRUCTURE", 5, 4, 1))
    return both.groupBy("file", "id").agg(F.max_by("parent_id", F.struct("rank", "rel")).alias("parent_id"))


def _points(entities: DataFrame) -> DataFrame:
    items = _arg(0)["items"]
    x, y, z = (F.coalesce(F.get(items, i)["num"], F.lit(0.0)) for i in range(3))
    known = (F.col("type") == "IFCCARTESIANPOINT") & (_arg(0)["kind"] == "list")
    return entities.select("file", F.col("id").alias("point"), *[F.when(known, c).otherwise(0.0).alias(n) for c, n in zip((x, y, z), "xyz", strict=True)])


def positions(entities: DataFrame) -> DataFrame:
    """file, placement, x, y, z: sums of the translations up the chain; broken, cyclic or too long chains have none."""
    local = entities.filter(F.col("type") == "IFCLOCALPLACEMENT")
    steps = local.select("file", F.col("id").alias("placement"), _arg(0)["ref"].alias("next"), _arg(1)["ref"].alias("axis"), (F.size("args") >= 2).alias("ok"))
    axes = entities.select("file", F.col("id").alias("axis"), F.when(F.col("type") == "IFCAXIS2PLACEMENT3D", _arg(0)["ref"]).alias("point"), F.lit(True).alias("has_axis"))
    steps = steps.join(axes, ["file", "axis"], "left").join(_points(entities).withColumn("has_point", F.lit(True)), ["file", "point"], "left")
    complete = F.col("ok") & (F.col("axis").isNull() | F.col("has_axis").isNotNull()) & (F.col("point").isNull() | F.col("has_point").isNotNull())
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    jumps = steps.select("file", "placement", "next", zero("x"), zero("y"), zero("z"), F.coalesce(complete, F.lit(False)).alias("ok"), F.lit(1).alias("hops"))
    for _ in range(MAX_HOPS.bit_length()):
        jumps = cut(jumps, "placements")
        if jumps.filter("next is not null").isEmpty():
            break
        further = jumps.select("file", F.col("placement").alias("next"), F.col("next").alias("_next"), *[F.col(c).alias(f"_{c}") for c in ("x", "y", "z", "ok", "hops")])
        there = F.col("next").isNull()
        added = [(F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in ("x", "y", "z")]
        joined = jumps.join(further, ["file", "next"], "left")
        jumps = joined.select("file", "placement", F.col("_next").alias("next"), *added, (F.col("ok") & (there | F.coalesce("_ok", F.lit(False)))).alias("ok"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"))
    return jumps.filter(F.col("ok") & F.col("next").isNull() & (F.col("hops") <= MAX_HOPS + 1)).select("file", "placement", "x", "y", "z")


def elements(entities: DataFrame) -> DataFrame:
    """file, ifc_id, name, element_type, parent_id, x, y, z."""
    kinds = F.create_map(*[F.lit(x) for pair in ELEMENT_TYPES.items() for x in pair])
    own = entities.withColumn("element_type", kinds[F.col("type")]).filter("element_type is not null")
    own = own.select("file", F.col("id"), F.coalesce(_arg(2)["str"], F.lit("")).alias("name"), "element_type", _arg(5)["ref"].alias("placement"))
    own = own.join(parents(entities), ["file", "id"], "left").join(positions(entities), ["file", "placement"], "left")
    return own.select("file", F.col("id").alias("ifc_id"), "name", "element_type", "parent_id", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in "xyz"])


def zones(entities: DataFrame, elements_: DataFrame) -> DataFrame:
    """file, zone_id, name, zone_type, floor_level, area_m2: storeys with their elevation, spaces with that of the storey they lie in directly."""
    levels = entities.filter(F.col("type") == "IFCBUILDINGSTOREY").select("file", F.col("id").alias("storey"), F.coalesce(_arg(9)["num"], F.lit(0.0)).alias("level"))
    own = elements_.filter(F.col("element_type").isin("storey", "space"))
    own = own.withColumn("storey", F.when(F.col("element_type") == "storey", F.col("ifc_id")).otherwise(F.col("parent_id")))
    out = own.join(levels, ["file", "storey"], "left")
    return out.select("file", F.col("ifc_id").alias("zone_id"), "name", F.col("element_type").alias("zone_type"), F.coalesce("level", F.lit(0.0)).alias("floor_level"), F.lit(0.0).alias("area_m2"))


def equipment(entities: DataFrame, elements_: DataFrame) -> DataFrame:
    """file, element_id, manufacturer, model, age_days, efficiency for every piece of equipment.

    The manufacturer is that of the first relation that names one; the model that of the best property, of equal ones from the first relation.
    """
    of = entities.filter(F.col("type") == "IFCRELDEFINESBYPROPERTIES")
    of = of.select("file", F.col("id").alias("rel"), _arg(5)["ref"].alias("set"), F.explode(_arg(4)["items"]["ref"]).alias("element_id"))
    sets = entities.filter(F.col("type") == "IFCPROPERTYSET").select("file", F.col("id").alias("set"), F.posexplode(_arg(4)["items"]["ref"]).alias("place", "property"))
    single = entities.filter((F.col("type") == "IFCPROPERTYSINGLEVALUE") & (_arg(0)["kind"] == "string") & (_arg(2)["kind"] == "string"))
    single = single.select("file", F.col("id").alias("property"), _arg(0)["str"].alias("property_name"), _arg(2)["str"].alias("value"))
    rows = of.join(sets, ["file", "set"]).join(single, ["file", "property"])
    rank = F.array_position(F.array(*[F.lit(m) for m in MODEL_PROPERTIES]), F.col("property_name"))
    rows = rows.withColumn("rank", rank)
    named = rows.groupBy("file", "element_id").agg(
        F.min_by("value", F.when(F.col("property_name") == "Manufacturer", F.struct("rel", "place"))).alias("manufacturer"),
        F.min_by("value", F.when(F.col("rank") > 0, F.struct("rank", "rel", "place"))).alias("model"),
    )
    own = elements_.filter(F.col("element_type") == "equipment").select("file", F.col("ifc_id").alias("element_id"))
    out = own.join(named, ["file", "element_id"], "left")
    return out.select("file", "element_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("manufacturer", "model")], F.lit(0.0).alias("age_days"), F.lit(0.0).alias("efficiency"))


def zone_floor(elements_: DataFrame, zones_: DataFrame) -> DataFrame:
    """file, zone_id, floor_id: a storey is its own floor, else the nearest storey above, else the zone itself."""
    own = elements_.select("file", F.col("ifc_id").alias("id"), F.when(F.col("element_type") == "storey", F.col("ifc_id")).alias("floor"), F.col("parent_id").alias("next"))
    jumps = own.withColumn("next", F.when(F.col("floor").isNull(), F.col("next")))
    for _ in range(MAX_HOPS.bit_length()):
        jumps = cut(jumps, "storeys")
        if jumps.filter("next is not null").isEmpty():
            break
        further = jumps.select("file", F.col("id").alias("next"), F.col("floor").alias("_floor"), F.col("next").alias("_next"))
        jumps = jumps.join(further, ["file", "next"], "left").select("file", "id", F.coalesce("floor", "_floor").alias("floor"), F.when(F.coalesce("floor", "_floor").isNull(), F.col("_next")).alias("next"))
    out = zones_.join(jumps.select("file", F.col("id").alias("zone_id"), "floor"), ["file", "zone_id"], "left")
    return out.select("file", "zone_id", F.coalesce("floor", "zone_id").alias("floor_id"))


def resolve(entities: DataFrame) -> Building:
    entities = cut(entities, "entities")  # files are parsed once
    own = cut(elements(entities), "elements")
    found = zones(entities, own)
    return Building(own, found, equipment(entities, own), zone_floor(own, found))
