"""The contract of a layout: a folder with versions of a readings table, and topology tables.

``v<n>`` holds a version, in it ``insert=<k>`` the readings of the k-th insert, or
those that a new version took over (k = 0). Each write goes to a folder of its
own and counts from when a marker in ``commits`` names it, so a write that fails
or is done again leaves nothing twice, and a layout can be opened again from its
path alone. Readers that hold a DataFrame of an older version keep it until
``drop`` or ``vacuum``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import RangeQuery
from ..operators import in_range, latest_single, prune, register, sensors_by_floor, sensors_by_zone

READING = "sensor_id long, ts_ms long, value double, sensor_type string"
STORED = f"{READING}, batch long, arrival long"
COLUMNS = [c.split(" ")[0] for c in STORED.split(", ")]


class Layout:
    """Subclasses say how a batch is written and which files a scan reads."""

    name = ""
    #: Queries that this layout can't answer in full.
    excluded: Sequence[str] = ()

    def __init__(self, spark: SparkSession, path: str):
        """Opens what lies at the path, or an empty layout."""
        self.spark, self.path = spark, path.rstrip("/")
        self.version, self.inserts, self.sources = 0, 0, set()
        for name in self._list(f"{self.path}/commits"):
            version, inserts, *source = name.split(".", 2)
            self.version = max(self.version, int(version))
            self.inserts = max(self.inserts, int(inserts))
            self.sources.update(source)

    # how a layout stores

    def write(self, rows: DataFrame, path: str) -> None:
        """Overwrite what an attempt before may have left at the path."""
        raise NotImplementedError

    def read(self, path: str) -> DataFrame:
        """The table with its folder's ``insert``."""
        return self.spark.read.schema(f"{STORED}, insert long").parquet(path)

    # files

    def _file_system(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._file_system(path)
        return fs.exists(p)

    def _delete(self, path: str) -> None:
        fs, p = self._file_system(path)
        fs.delete(p, True)

    def _list(self, path: str) -> list[str]:
        fs, p = self._file_system(path)
        return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []

    def _commit(self, source: str | None = None) -> None:
        fs, p = self._file_system(f"{self.path}/commits/{self.version}.{self.inserts}{'' if source is None else f'.{source}'}")
        fs.create(p, True).close()

    @property
    def _data(self) -> str:
        return f"{self.path}/v{self.version}"

    def _stored(self) -> DataFrame:
        """The readings of committed writes, with their place in the order of arrival."""
        if not self._exists(self._data):
            return self.spark.createDataFrame([], STORED)
        return self.read(self._data).filter(F.col("insert") <= self.inserts).select(*COLUMNS)

    # the contract

    def insert(self, readings: DataFrame, source: str | None = None) -> None:
        """Append a batch. Batches arrive one after another, their readings in the order of the DataFrame.

        With an ``arrival`` column of their own, readings are ordered by it among
        all such batches, and come before those of batches without. A batch of
        a ``source`` that was inserted before is left out.
        """
        if source is not None and source in self.sources:
            return
        if "arrival" in readings.columns:
            rows = readings.withColumn("batch", F.lit(0).cast("long"))
        else:
            rows = readings.withColumn("batch", F.lit(self.inserts + 1).cast("long")).withColumn("arrival", F.monotonically_increasing_id())
        self.append(rows.select(*COLUMNS), f"{self._data}/insert={self.inserts + 1}")
        self.inserts += 1
        self._commit(source)
        if source is not None:
            self.sources.add(source)

    def append(self, rows: DataFrame, path: str) -> None:
        self.write(rows, path)

    def replace(self, rows: DataFrame) -> None:
        """A new version of the table, in one write."""
        self.write(rows, f"{self.path}/v{self.version + 1}/insert=0")
        self.version += 1
        self._commit()

    def readings(self) -> DataFrame:
        return self._stored().drop("batch", "arrival")

    def count(self) -> int:
        return self._stored().count()

    def memory_used(self) -> int:
        """Bytes of the present version."""
        if not self._exists(self._data):
            return 0
        fs, p = self._file_system(self._data)
        return fs.getContentSummary(p).getLength()

    def latest(self, sensor_id: int | None = None) -> DataFrame:
        return latest_single(self.readings(), sensor_id)

    def range(self, query: RangeQuery) -> DataFrame:
        return in_range(self.readings(), query)

    def _register(self, table: str, rows: DataFrame) -> None:
        path, order = f"{self.path}/{table}", 0
        if self._exists(path):
            order = self.spark.read.parquet(path).agg(F.max("seq")).first()[0] + 1
        rows.withColumn("seq", F.lit(order).cast("long")).write.mode("append").parquet(path)

    def _topology(self, table: str, key: str, value: str) -> DataFrame:
        path = f"{self.path}/{table}"
        if not self._exists(path):
            return self.spark.createDataFrame([], f"{key} long, {value} long")
        return register(self.spark.read.parquet(path), key, order="seq").select(key, value)

    def register_zones(self, sensor_zone: DataFrame) -> None:
        """sensor_id, zone_id; a later registration of a sensor moves it."""
        self._register("zones", sensor_zone.select("sensor_id", "zone_id"))

    def register_floors(self, zone_floor: DataFrame) -> None:
        self._register("floors", zone_floor.select("zone_id", "floor_id"))

    def sensor_zone(self) -> DataFrame:
        return self._topology("zones", "sensor_id", "zone_id")

    def zone_floor(self) -> DataFrame:
        return self._topology("floors", "zone_id", "floor_id")

    def sensors_by_zone(self, zone_id: int) -> DataFrame:
        return sensors_by_zone(self.sensor_zone(), zone_id)

    def sensors_by_floor(self, floor_id: int) -> DataFrame:
        return sensors_by_floor(self.sensor_zone(), self.zone_floor(), floor_id)

    def floor_of_zone(self, zone_id: int) -> int | None:
        row = self.zone_floor().filter(F.col("zone_id") == zone_id).first()
        return row.floor_id if row else None

    def prune_older_than(self, sensor_type: str, cutoff_ms: int) -> int:
        """Drop the type's readings from before the cutoff; how many went."""
        return self.prune_by_age({sensor_type: cutoff_ms})

    def prune_by_age(self, cutoffs_ms: Mapping[str, int]) -> int:
        """Drop each type's readings from before its cutoff, in one rewrite if there are any; how many went."""
        kept = stored = self._stored()
        for sensor_type, cutoff in cutoffs_ms.items():
            kept = prune(kept, sensor_type, cutoff)
        gone = stored.count() - kept.count()
        if gone:
            self.replace(kept)
        return gone

    def vacuum(self) -> None:
        """Delete older versions."""
        for v in range(self.version):
            self._delete(f"{self.path}/v{v}")

    def drop(self) -> None:
        self._delete(self.path)
        self.version, self.inserts, self.sources = 0, 0, set()
