"""The registered queries as SQL over the stored tables."""

from __future__ import annotations

from ..layouts import LAYOUTS
from ..model import DAY_MS, DEFAULT_AREA_M2, EXPECTED_WINNERS, HOUR_MS, PLACEMENT_RULES, PROFILES
from . import queries as q

_R = f"""r AS (SELECT user_id AS sensor_id, epoch_us(ts) // 1000 AS ts_ms, value, event_id AS arrival,
    CASE event_type WHEN 'click' THEN 'temperature' WHEN 'error' THEN 'humidity' WHEN 'purchase' THEN 'co2' WHEN 'signup' THEN 'occupancy' WHEN 'view' THEN 'energy' END AS sensor_type FROM events),
  sz AS (SELECT DISTINCT user_id AS sensor_id, user_id // 5 AS zone_id FROM events),
  zf AS (SELECT DISTINCT zone_id, zone_id // 2 AS floor_id FROM sz),
  sf AS (SELECT sensor_id, floor_id FROM sz JOIN zf USING (zone_id)),
  typed AS (SELECT * FROM r WHERE sensor_type = '{q.TYPE}'),
  p(sensor_type, amplitude, peak_hour, min_value, max_value, retention_days) AS (VALUES {", ".join(f"('{p.sensor_type}', {float(p.amplitude)}::DOUBLE, {float(p.peak_hour)}::DOUBLE, {float(p.min_value)}::DOUBLE, {float(p.max_value)}::DOUBLE, {p.retention_days})" for p in PROFILES)})"""

_READING = "sensor_id, ts_ms, value, sensor_type"
_ROLLUP = "round(avg(value) + 3.7e-10, 6) AS avg_value, min(value) AS min_value, max(value) AS max_value, count(*) AS n"


def _with(body: str, *ctes: str) -> str:
    return f"WITH {', '.join([_R, *ctes])} {body}"


def _latest(rows: str) -> str:
    return _with(f"SELECT {_READING} FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY ts_ms DESC, value DESC, sensor_type DESC) AS k FROM ({rows})) WHERE k = 1")


def _trailing(rows: str, keys: str, ms: int, select: str, group: str = "") -> str:
    over = f"PARTITION BY {keys}" if keys else ""
    return _with(f"SELECT {select} FROM w WHERE ts_ms >= latest - {ms}" + (f" GROUP BY {group}" if group else ""), f"w AS (SELECT *, max(ts_ms) OVER ({over}) AS latest FROM ({rows}))")


def _breach(rows: str, threshold: float) -> str:
    return _with(
        f"SELECT sensor_id, start_ts, end_ts, end_ts - start_ts AS duration_ms, peak_value FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY run) AS k FROM runs WHERE end_ts - start_ts >= {q.MIN_DURATION_MS}) WHERE k = 1",
        f"m AS (SELECT sensor_id, ts_ms, value, value > {threshold} AS above FROM ({rows}))",
        "n AS (SELECT *, sum(CASE WHEN above THEN 0 ELSE 1 END) OVER (PARTITION BY sensor_id ORDER BY ts_ms, value ROWS UNBOUNDED PRECEDING) AS run FROM m)",
        "runs AS (SELECT sensor_id, run, min(ts_ms) AS start_ts, max(ts_ms) AS end_ts, max(value) AS peak_value FROM n WHERE above GROUP BY sensor_id, run)",
    )


def _anomalies(rows: str, columns: str) -> str:
    return _with(
        f"SELECT {columns}, round((value - m) / d + 3.7e-10, 6) AS z_score FROM ({rows}) AS x JOIN st USING (sensor_type) WHERE n >= 2 AND lo < hi AND abs((value - m) / d) > {q.K}",
        f"st AS (SELECT sensor_type, avg(value) AS m, stddev_pop(value) AS d, count(*) AS n, min(value) AS lo, max(value) AS hi FROM ({rows}) GROUP BY sensor_type)",
    )


_ZONE = f"SELECT typed.* FROM typed WHERE sensor_id IN (SELECT sensor_id FROM sz WHERE zone_id = {q.ZONE})"
_FLOOR = f"SELECT typed.* FROM typed WHERE sensor_id IN (SELECT sensor_id FROM sf WHERE floor_id = {q.FLOOR})"
_AVG0 = "coalesce(round(avg(value) + 3.7e-10, 6), 0.0) AS avg_value"
_WEEK, _DAY = q.WEEK_HOURS * HOUR_MS, 24 * HOUR_MS
_IN_RANGE = f"ts_ms BETWEEN {q.RANGE.start} AND {q.RANGE.end}"
_HOUR = "(ts_ms % 86400000) / 3600000.0"


def _near(hour: str) -> str:
    return f"least(abs({_HOUR} - {hour}), 24 - abs({_HOUR} - {hour})) <= 2"


_TROUGH = "(CASE WHEN peak_hour + 12 >= 24 THEN peak_hour - 12 ELSE peak_hour + 12 END)"

ORACLE_SQL: dict[str, str] = {
    "latest_single": _latest(f"SELECT * FROM r WHERE sensor_id = {q.SENSOR}"),
    "latest_all": _latest("SELECT * FROM r"),
    "latest_zone": _latest(f"SELECT r.* FROM r WHERE sensor_id IN (SELECT sensor_id FROM sz WHERE zone_id = {q.ZONE})"),
    "latest_by_type": _latest("SELECT * FROM typed"),
    "avg_window": _trailing(f"SELECT * FROM r WHERE sensor_id = {q.SENSOR}", "", _DAY, _AVG0),
    "avg_window_week": _trailing(f"SELECT * FROM r WHERE sensor_id = {q.SENSOR}", "", _WEEK, _AVG0),
    "avg_window_all": _trailing("SELECT * FROM r", "sensor_id", _WEEK, "sensor_id, round(avg(value) + 3.7e-10, 6) AS avg_value", "sensor_id"),
    "avg_window_unknown": _trailing("SELECT * FROM r WHERE sensor_id = -1", "", _DAY, _AVG0),
    "avg_zone_type": _trailing(_ZONE, "", _DAY, _AVG0),
    "avg_zone_type_week": _trailing(_ZONE, "", _WEEK, _AVG0),
    "avg_zone_type_all": _trailing("SELECT r.*, zone_id FROM r JOIN sz USING (sensor_id)", "zone_id, sensor_type", _WEEK, "zone_id, sensor_type, round(avg(value) + 3.7e-10, 6) AS avg_value", "zone_id, sensor_type"),
    "floor_stats": _trailing(_FLOOR, "", _DAY, f"coalesce(min(value), 0.0) AS min_value, coalesce(max(value), 0.0) AS max_value, {_AVG0}"),
    "floor_stats_all": _trailing("SELECT r.*, floor_id FROM r JOIN sf USING (sensor_id)", "floor_id, sensor_type", _WEEK, "floor_id, sensor_type, min(value) AS min_value, max(value) AS max_value, round(avg(value) + 3.7e-10, 6) AS avg_value", "floor_id, sensor_type"),
    "hourly_rollup": _trailing(f"SELECT * FROM r WHERE sensor_id = {q.SENSOR}", "", 2 * DAY_MS, f"ts_ms - ts_ms % {HOUR_MS} AS bucket_ms, {_ROLLUP}", "bucket_ms"),
    "hourly_rollup_all": _trailing("SELECT * FROM r", "sensor_id", 7 * DAY_MS, f"sensor_id, ts_ms - ts_ms % {HOUR_MS} AS bucket_ms, {_ROLLUP}", "sensor_id, bucket_ms"),
    "daily_zone_rollup": _trailing(_ZONE, "", 365 * DAY_MS, f"ts_ms - ts_ms % {DAY_MS} AS bucket_ms, {_ROLLUP}", "bucket_ms"),
    "daily_zone_rollup_all": _trailing("SELECT r.*, zone_id FROM r JOIN sz USING (sensor_id)", "zone_id, sensor_type", 365 * DAY_MS, f"zone_id, sensor_type, ts_ms - ts_ms % {DAY_MS} AS bucket_ms, {_ROLLUP}", "zone_id, sensor_type, bucket_ms"),
    "spatial_radius": _with(f"SELECT DISTINCT sensor_id FROM r WHERE pow((sensor_id % 10) * 5.0 - {q.CENTER[0]}, 2) + pow((sensor_id // 10) * 3.0 - {q.CENTER[1]}, 2) + pow(0.0 - {q.CENTER[2]}, 2) <= {q.RADIUS**2}"),
    "zone_hierarchy_d0": _with(f"SELECT sensor_id FROM sz WHERE zone_id = {q.ZONE}"),
    "zone_hierarchy_d1": _with(f"SELECT sensor_id FROM sf WHERE floor_id IN (SELECT floor_id FROM zf WHERE zone_id = {q.ZONE})"),
    "zone_hierarchy_d2": _with("SELECT DISTINCT sensor_id FROM r"),
    "anomalies": _anomalies("SELECT * FROM typed", "sensor_id, ts_ms, value"),
    "anomalies_all_types": _anomalies("SELECT * FROM r", _READING),
    "threshold_breach": _breach(f"SELECT * FROM r WHERE sensor_id = {q.SENSOR}", q.THRESHOLD),
    "threshold_breach_all": _breach("SELECT * FROM r", q.BREACH_ALL),
    "total_count": _with("SELECT count(*) AS n FROM r"),
    "average_value": _with(f"SELECT {_AVG0} FROM r"),
    "all_readings": _with(f"SELECT {_READING} FROM r"),
    "range_scan": _with(f"SELECT {_READING} FROM r WHERE {_IN_RANGE}"),
    "range_scan_inverted": _with(f"SELECT {_READING} FROM r WHERE ts_ms BETWEEN {q.RANGE.end} AND {q.RANGE.start}"),
    "range_avg": _with(f"SELECT {_AVG0} FROM r WHERE {_IN_RANGE}"),
    "range_count_sensor": _with(f"SELECT count(*) AS n FROM r WHERE sensor_id = {q.SENSOR} AND {_IN_RANGE}"),
    "all_sensor_ids": _with("SELECT DISTINCT sensor_id FROM r"),
    "readings_for_sensor": _with(f"SELECT {_READING} FROM r WHERE sensor_id = {q.SENSOR}"),
    "readings_for_type": _with(f"SELECT {_READING} FROM typed"),
    "type_stats": _with("SELECT sensor_type, round(avg(value) + 3.7e-10, 6) AS mean_value, round(stddev_pop(value) + 3.7e-10, 6) AS std_dev, count(*) AS n FROM r GROUP BY sensor_type"),
    "sensors_by_zone": _with("SELECT sensor_id, zone_id FROM sz WHERE zone_id = 1"),
    "sensors_by_floor": _with("SELECT sensor_id, floor_id FROM sf WHERE floor_id = 1"),
    "floor_of_zone": _with("SELECT zone_id, floor_id FROM zf"),
    "silent_sensors": _with("SELECT sensor_id, zone_id FROM sz WHERE sensor_id NOT IN (SELECT sensor_id FROM r WHERE ts_ms BETWEEN 1706600000000 AND 1800000000000)"),
    "prune_type": _with(f"SELECT {_READING} FROM r WHERE NOT (sensor_type = '{q.TYPE}' AND ts_ms < {q.CUTOFF_MS})"),
    "prune_retention": _with(f"SELECT sensor_type, count(*) AS n, min(ts_ms) AS oldest_ms FROM r, (SELECT max(ts_ms) AS now FROM r) WHERE ts_ms >= now - CASE sensor_type WHEN 'co2' THEN 0 ELSE 20 END * {DAY_MS}::BIGINT GROUP BY sensor_type"),
    "ring_last_n": _with(f"SELECT {_READING}, arrival FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY arrival DESC) AS k FROM r) WHERE k <= {q.RING}"),
    "bounds_violations": _with(f"SELECT {_READING}, min_value, max_value FROM r JOIN p USING (sensor_type) WHERE value < min_value OR value > max_value"),
    "daily_pattern": _with(
        "SELECT p.sensor_type, round(pa + 3.7e-10, 6) AS peak_avg, round(ta + 3.7e-10, 6) AS trough_avg, CASE WHEN amplitude = 0 THEN true ELSE coalesce(pa - ta >= 0.5 * amplitude, false) END AS has_pattern FROM p LEFT JOIN m USING (sensor_type)",
        f"m AS (SELECT sensor_type, avg(value) FILTER (WHERE {_near('peak_hour')}) AS pa, avg(value) FILTER (WHERE {_near(_TROUGH)}) AS ta FROM r JOIN p USING (sensor_type) GROUP BY sensor_type)",
    ),
    "value_at": _latest(f"SELECT * FROM r WHERE ts_ms <= {q.RANGE.start}"),
    "recommend_scores": f"""
        WITH runs(scale, query, layout, median_ns) AS (VALUES {", ".join(f"('{s}', '{x}', '{y}', {m}::DOUBLE)" for s, x, y, m in q.RECOMMEND_RUNS)}),
        mix AS (SELECT query, sum(weight) AS weight FROM (VALUES {", ".join(f"('{x}', {w}::DOUBLE)" for x, w in q.RECOMMEND_MIX)}) AS t(query, weight) GROUP BY query),
        best AS (SELECT query, min(median_ns) AS best FROM runs WHERE scale = 's' GROUP BY query)
        SELECT layout, round(sum(weight * median_ns / best) / sum(weight) + 3.7e-10, 6) AS score, round(sum(weight) / (SELECT sum(weight) FROM mix) + 3.7e-10, 6) AS coverage
        FROM runs JOIN mix USING (query) JOIN best USING (query) WHERE scale = 's' GROUP BY layout""",
}

# The generated building: every line takes the next number. Before the blocks come 6 lines; a block has 4 before its
# floors and 1 after, a floor 4 before its rooms and 3 after, a room 11.
_FLOOR_LINES = f"(7 + 11 * {q.ROOMS})"
_BUILDING = f"""blocks AS (SELECT b, 6 + b * (5 + {q.FLOORS} * {_FLOOR_LINES}) AS b0 FROM range({q.BLOCKS}) AS t(b)),
    floors AS (SELECT b, f, b0 + 4 + f * {_FLOOR_LINES} AS f0, b0 + 4 AS building, b0 + 8 + f * {_FLOOR_LINES} AS storey FROM blocks, range({q.FLOORS}) AS t(f)),
    rooms AS (SELECT *, storey + 11 * r AS r0, b * 80.0 + r % 6 * 6.0 AS rx, r // 6 * 5.0 AS ry FROM floors, range({q.ROOMS}) AS t(r)),
    parts(k, element_type, part) AS (VALUES (4, 'space', NULL), (5, 'wall', 'Wall'), (6, 'flow_segment', 'Duct'), (7, 'equipment', 'Terminal')),
    elements AS (
      SELECT 1 AS ifc_id, 'Campus' AS name, 'project' AS element_type, NULL AS parent_id, 0.0 AS x, 0.0 AS y, 0.0 AS z
      UNION ALL SELECT 2, 'Site', 'site', 1, 0.0, 0.0, 0.0
      UNION ALL SELECT b0 + 4, 'Block ' || b, 'building', 2, b * 80.0, 0.0, 0.0 FROM blocks
      UNION ALL SELECT storey, 'Block ' || b || ' floor ' || f, 'storey', building, b * 80.0, 0.0, f * 3.5 FROM floors
      UNION ALL SELECT r0 + k, coalesce(part, 'Room ' || b || '.' || f || '.' || r), element_type, storey, rx, ry, f * 3.5 FROM rooms, parts
      UNION ALL SELECT storey + 11 * {q.ROOMS} + 1, 'Beam', 'beam', storey, b * 80.0, 0.0, f * 3.5 FROM floors)"""
_ELEMENT = "ifc_id::BIGINT AS ifc_id, name, element_type, parent_id::BIGINT AS parent_id, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z"
_RULES = ", ".join(f"('{element}', {n}, '{t}')" for element, types in PLACEMENT_RULES.items() for n, t in enumerate(types))
_DENSITY = ", ".join(f"('{p.sensor_type}', {p.density}::DOUBLE, 1000.0::DOUBLE / {p.period_ms})" for p in PROFILES)
_EXPECTED = ", ".join(f"('{k}', {v}::VARCHAR[])" for k, v in EXPECTED_WINNERS.items())

ORACLE_SQL |= {
    "ifc_elements": f"WITH {_BUILDING} SELECT {_ELEMENT} FROM elements",
    "building_zones": f"""WITH {_BUILDING}
        SELECT storey::BIGINT AS zone_id, 'Block ' || b || ' floor ' || f AS name, 'storey' AS zone_type, f * 3.5::DOUBLE AS floor_level, 0.0::DOUBLE AS area_m2, storey::BIGINT AS floor_id FROM floors
        UNION ALL SELECT (r0 + 4)::BIGINT, 'Room ' || b || '.' || f || '.' || r, 'space', f * 3.5::DOUBLE, 0.0::DOUBLE, storey::BIGINT FROM rooms""",
    "building_equipment": f"WITH {_BUILDING} SELECT (r0 + 7)::BIGINT AS element_id, 'Maker ' || r % 3 AS manufacturer, 'Type ' || r % 5 AS model, 0.0::DOUBLE AS age_days, 0.0::DOUBLE AS efficiency FROM rooms",
    "placed_sensors": f"""WITH {_BUILDING},
        rules(element_type, place, sensor_type) AS (VALUES {_RULES}),
        density(sensor_type, density, frequency_hz) AS (VALUES {_DENSITY}),
        rows AS (SELECT *, unnest(range(greatest(1, round(density * {DEFAULT_AREA_M2} / 100)::INT))) AS copy FROM elements JOIN rules USING (element_type) JOIN density USING (sensor_type))
        SELECT (row_number() OVER (ORDER BY ifc_id, place, copy) - 1)::BIGINT AS sensor_id, sensor_type, frequency_hz, ifc_id::BIGINT AS element_id,
               CASE WHEN element_type = 'space' THEN ifc_id ELSE parent_id END::BIGINT AS zone_id, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z FROM rows""",
    "winners": f"""
        WITH runs(scale, query, layout, median_ns) AS (VALUES {", ".join(f"('{s}', '{x}', '{y}', {m}::DOUBLE)" for s, x, y, m in q.WINNER_RUNS)}),
        expected(query, expected) AS (VALUES {_EXPECTED}),
        ranked AS (SELECT *, row_number() OVER w AS k, lead(layout) OVER w AS runner_up, lead(median_ns) OVER w AS runner_up_ns FROM runs WINDOW w AS (PARTITION BY scale, query ORDER BY median_ns, layout))
        SELECT scale, query, layout AS winner, median_ns, runner_up, runner_up_ns, CASE WHEN len(expected) > 0 THEN list_contains(expected, layout) END AS as_expected FROM ranked LEFT JOIN expected USING (query) WHERE k = 1""",
}
for _name in LAYOUTS:
    ORACLE_SQL[f"layout_{_name.lower()}_range"] = _with(f"SELECT {_READING} FROM r WHERE {_IN_RANGE} AND NOT (sensor_type = '{q.TYPE}' AND ts_ms < {q.RANGE.start})")
