"""A drawing of sensors and zones, a panel a floor."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import project

#: A floor's panel and its margin, in pixels; the least extent it shows and what is added to a smaller one, in metres.
PANEL_W, PANEL_H, MARGIN, LEAST_SPAN, PAD = 720.0, 360.0, 32.0, 2.0, 3.0


def color(sensor_type: str, types: list[str]) -> str:
    """Hues of the types present, evenly around the circle."""
    return f"hsl({360 * types.index(sensor_type) // len(types)} 65% 45%)"


def points(sensors: DataFrame, locations: DataFrame, elements: DataFrame, zones: DataFrame, zone_floor: DataFrame) -> DataFrame:
    """kind, label, floor_id, x, y of sensors and zones, with the place in their floor's panel as px, py."""
    floor = F.coalesce("floor_id", F.col("zone_id"))
    s = sensors.join(locations, ["file", "sensor_id"]).join(zone_floor, ["file", "zone_id"], "left").select(F.lit("sensor").alias("kind"), F.col("sensor_type").alias("label"), floor.alias("floor_id"), "x", "y")
    where = elements.select("file", F.col("ifc_id").alias("zone_id"), "x", "y")
    z = zones.join(where, ["file", "zone_id"]).join(zone_floor, ["file", "zone_id"], "left").select(F.lit("zone").alias("kind"), F.col("name").alias("label"), floor.alias("floor_id"), "x", "y")
    rows = s.unionByName(z)
    pad = lambda c: F.when(F.max(c) - F.min(c) < LEAST_SPAN, PAD).otherwise(0.0)
    bounds = rows.groupBy("floor_id").agg(*[f(c).alias(n) for c in "xy" for f, n in ((lambda v: F.min(v) - pad(v), f"low_{c}"), (lambda v: F.max(v) + pad(v), f"high_{c}"))])
    rows = rows.join(bounds, "floor_id")
    px = project(F.col("x"), F.col("low_x"), F.col("high_x"), PANEL_W, MARGIN)
    py = project(F.col("y"), F.col("low_y"), F.col("high_y"), PANEL_H, MARGIN)
    return rows.select("kind", "label", "floor_id", "x", "y", px.alias("px"), py.alias("py"))


def svg(title: str, rows: list) -> str:
    """rows: collected points; one building's, so the drawing bounds them."""
    floors = sorted({r.floor_id for r in rows})
    types = sorted({r.label for r in rows if r.kind == "sensor"})
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{PANEL_W:.0f}" height="{PANEL_H * max(1, len(floors)):.0f}"><title>{html.escape(title)}</title>']
    for n, floor in enumerate(floors):
        top = n * PANEL_H
        out.append(f'<text x="10" y="{top + 20:.0f}">Floor {floor}</text><rect x="5" y="{top + 5:.0f}" width="{PANEL_W - 10:.0f}" height="{PANEL_H - 10:.0f}" fill="none" stroke="#999"/>')
        for r in sorted((r for r in rows if r.floor_id == floor), key=lambda r: (r.kind == "sensor", r.label, r.px, r.py)):
            if r.kind == "zone":
                out.append(f'<rect x="{r.px - 6:.1f}" y="{top + r.py - 6:.1f}" width="12" height="12" fill="#e5e7eb" stroke="#6b7280"/><text x="{r.px + 9:.1f}" y="{top + r.py + 4:.1f}" font-size="10">{html.escape(r.label)}</text>')
            else:
                out.append(f'<circle cx="{r.px:.1f}" cy="{top + r.py:.1f}" r="4" fill="{color(r.label, types)}"/>')
    return "\n".join([*out, "</svg>"])
