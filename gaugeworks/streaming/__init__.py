"""The same questions asked of a stream of readings."""

from .stateful import buckets, daily, first_breach, hourly, latest, ring, sink

__all__ = ["buckets", "daily", "first_breach", "hourly", "latest", "ring", "sink"]
