"""The six layouts. Each comment says what a scan can skip."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import RING_CAPACITY
from ..operators import keep_last
from .base import STORED, Layout


class RowLog(Layout):
    """Rows as text in the order of arrival: every query reads everything."""

    name = "AoS"

    def write(self, rows: DataFrame, path: str) -> None:
        rows.write.mode("overwrite").json(path)

    def read(self, path: str) -> DataFrame:
        return self.spark.read.schema(f"{STORED}, insert long").json(path)


class UnsortedColumns(Layout):
    """Columns in the order of arrival: columns are skipped, rows are not."""

    name = "SoA"

    def write(self, rows: DataFrame, path: str) -> None:
        rows.write.mode("overwrite").parquet(path)


class TimeSeries(Layout):
    """Sorted by time across files: ranges of time skip files and row groups by their extremes."""

    name = "TimeSeries"

    def write(self, rows: DataFrame, path: str) -> None:
        rows.repartitionByRange("ts_ms").sortWithinPartitions("ts_ms", "sensor_id").write.mode("overwrite").parquet(path)


class Columnar(Layout):
    """A folder a type, sorted by sensor and time, times delta-coded: typed queries read their folder, sensors skip row groups."""

    name = "Columnar"

    def write(self, rows: DataFrame, path: str) -> None:
        rows.repartitionByRange("sensor_type", "sensor_id").sortWithinPartitions("sensor_type", "sensor_id", "ts_ms").write.mode("overwrite").option("parquet.writer.version", "v2").partitionBy("sensor_type").parquet(path)


class Hierarchical(Layout):
    """A folder a floor and zone, sorted by sensor and time: zone and floor queries read theirs. Sensors without a zone lie under -1."""

    name = "Hierarchical"

    def write(self, rows: DataFrame, path: str) -> None:
        placed = rows.join(self.sensor_zone(), "sensor_id", "left").join(self.zone_floor(), "zone_id", "left")
        placed = placed.fillna(-1, ["zone_id", "floor_id"])
        placed.repartitionByRange("floor_id", "zone_id", "sensor_id").sortWithinPartitions("floor_id", "zone_id", "sensor_id", "ts_ms").write.mode("overwrite").partitionBy("floor_id", "zone_id").parquet(path)

    def read(self, path: str) -> DataFrame:
        return self.spark.read.schema(f"{STORED}, insert long, floor_id long, zone_id long").parquet(path)

    def _place(self) -> None:
        """Readings move to their sensors' present zones."""
        if self.count():
            self.replace(self._stored())

    def register_zones(self, sensor_zone: DataFrame) -> None:
        super().register_zones(sensor_zone)
        self._place()

    def register_floors(self, zone_floor: DataFrame) -> None:
        super().register_floors(zone_floor)
        self._place()

    def zone_readings(self, zone_id: int) -> DataFrame:
        """A zone's readings, from its folder alone."""
        if not self._exists(self._data):
            return self.readings()
        return self.read(self._data).filter((F.col("zone_id") == zone_id) & (F.col("insert") <= self.inserts)).select("sensor_id", "ts_ms", "value", "sensor_type")


class RingBuffer(Layout):
    """The last readings of every sensor by arrival.

    An insert appends the batch's own last readings; reading keeps the last of
    all. Every ``compact``-th insert rewrites what is kept, so writes cost a
    fraction of the ring and reads never see more than so many batches beside it.
    The latest is that of the readings kept, so it can't outlive them.
    """

    name = "RingBuffer"
    excluded = ("hourly_rollup", "daily_zone_rollup")

    def __init__(self, spark, path: str, capacity: int = RING_CAPACITY, compact: int = 16):
        super().__init__(spark, path)
        self.capacity, self.compact = capacity, compact

    def write(self, rows: DataFrame, path: str) -> None:
        kept = keep_last(rows, self.capacity, "batch", "arrival")
        kept.repartitionByRange("sensor_id").sortWithinPartitions("sensor_id", "batch", "arrival").write.mode("overwrite").parquet(path)

    def _stored(self) -> DataFrame:
        return keep_last(super()._stored(), self.capacity, "batch", "arrival")

    def insert(self, readings: DataFrame, source: str | None = None) -> None:
        super().insert(readings, source)
        if len(self._list(self._data)) > self.compact:
            self.replace(self._stored())


LAYOUTS: dict[str, type[Layout]] = {c.name: c for c in (RowLog, UnsortedColumns, TimeSeries, Columnar, Hierarchical, RingBuffer)}
#: Those that the benchmark compares; the first two are what results are held against.
BENCHMARKED = ["TimeSeries", "Columnar", "Hierarchical", "RingBuffer"]
