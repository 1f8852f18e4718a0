"""Building files as a table of entities: one task a file, from any file system that Spark reads."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import spf

_ITEM = [T.StructField("kind", T.StringType()), T.StructField("ref", T.LongType()), T.StructField("num", T.DoubleType()), T.StructField("str", T.StringType())]
ARGUMENT = T.StructType([*_ITEM, T.StructField("items", T.ArrayType(T.StructType(_ITEM)))])
ENTITIES = T.StructType([T.StructField("file", T.StringType()), T.StructField("id", T.LongType()), T.StructField("type", T.StringType()), T.StructField("args", T.ArrayType(ARGUMENT))])

#: Entities of a batch.
BATCH = 10_000


def _rows(file: str, text: str) -> Iterator[dict]:
    for number, name, args in spf.parse(text):
        yield {"file": file, "id": number, "type": name, "args": [a.record() for a in args]}


def entities(spark: SparkSession, path: str) -> DataFrame:
    """file, id, type, args of all building files at the path."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(ENTITIES)
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[dict] = []
                for row in _rows(file, content.decode("utf-8", "replace")):
                    rows.append(row)
                    if len(rows) == BATCH:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, ENTITIES)


class SpfDataSource(DataSource):
    """``spark.read.format("ifc").load(path)`` for files that Python can open."""

    @classmethod
    def name(cls) -> str:
        return "ifc"

    def schema(self) -> T.StructType:
        return ENTITIES

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SpfReader(self.options)


class SpfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        import glob
        import os

        found = sorted(glob.glob(os.path.join(self.path, "*.ifc"))) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        return [InputPartition(f) for f in found]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        item = lambda v: (v["kind"], v["ref"], v["num"], v["str"])
        with open(partition.value, encoding="utf-8", errors="replace") as f:
            for row in _rows(partition.value, f.read()):
                yield row["file"], row["id"], row["type"], [(*item(a), [item(x) for x in a["items"]]) for a in row["args"]]
