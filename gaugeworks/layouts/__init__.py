"""Six ways to lay readings out on disk, with one contract."""

from .base import Layout
from .strategies import BENCHMARKED, LAYOUTS, Columnar, Hierarchical, RingBuffer, RowLog, TimeSeries, UnsortedColumns

__all__ = ["BENCHMARKED", "LAYOUTS", "Columnar", "Hierarchical", "Layout", "RingBuffer", "RowLog", "TimeSeries", "UnsortedColumns"]
