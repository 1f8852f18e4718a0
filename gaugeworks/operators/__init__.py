"""Operators over readings and topology. Each works on all keys at once; key arguments narrow it."""

from .aggregation import avg_window, avg_zone_type, floor_stats
from .anomaly import anomalies, threshold_breach, type_stats
from .historical import daily_zone_rollup, hourly_rollup
from .realtime import latest_by_type, latest_single, latest_zone, value_at
from .retention import bounds_violations, daily_pattern, keep_last, prune, prune_by_profile
from .spatial import spatial_radius, zone_hierarchy
from .system import average, average_in_range, count_for_sensor, in_range, sensor_ids, total_count
from .topology import floor_of_zone, register, sensors_by_floor, sensors_by_zone, silent_sensors

__all__ = [
    "anomalies", "average", "average_in_range", "avg_window", "avg_zone_type", "bounds_violations", "count_for_sensor", "daily_pattern", "daily_zone_rollup",
    "floor_of_zone", "floor_stats", "hourly_rollup", "in_range", "keep_last", "latest_by_type", "latest_single", "latest_zone", "prune", "prune_by_profile",
    "register", "sensor_ids", "sensors_by_floor", "sensors_by_zone", "silent_sensors", "spatial_radius", "threshold_breach", "total_count", "type_stats", "value_at", "zone_hierarchy",
]
