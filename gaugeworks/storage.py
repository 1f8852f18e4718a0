"""Tables in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and
    everything runs in one process (tests) a temporary folder takes its place.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="gaugeworks-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/gaugeworks/{spark.sparkContext.applicationId}"


_within: ContextVar[str] = ContextVar("scratch", default="")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables cut within are deleted at the end."""
    before = _within.get()
    token = _within.set(f"{before}/{uuid.uuid4().hex}")
    try:
        yield
    finally:
        _delete(spark, f"{_own_dir(spark)}{_within.get()}")
        _within.reset(token)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path among this application's tables."""
    return f"{_own_dir(spark)}{_within.get()}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str, codec: str = "zstd", path: str | None = None) -> DataFrame:
    """Write and read back: iterations keep a short plan, and lost executors lose nothing."""
    path = path or scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete this application's tables; DataFrames that still read them fail from then on."""
    _delete(spark, _own_dir(spark))
