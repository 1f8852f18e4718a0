"""Streaming forms: latest per sensor, buckets, sustained breaches, the last n, and a sink with retention.

Each takes a streaming DataFrame of readings and gives a streaming DataFrame.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..model import DAY_MS, HOUR_MS, RING_CAPACITY


def latest(readings: DataFrame) -> DataFrame:
    """Each sensor's latest reading so far; for the complete or update mode."""
    last = readings.groupBy("sensor_id").agg(F.max(F.struct("ts_ms", "value", "sensor_type")).alias("last"))
    return last.select("sensor_id", "last.ts_ms", "last.value", "last.sensor_type")


def buckets(readings: DataFrame, width_ms: int, late: str, keys: Sequence[str] = ("sensor_id",)) -> DataFrame:
    """Buckets of UTC time by the keys, closed once readings are later than the watermark."""
    timed = readings.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", late)
    stats = [F.avg("value").alias("avg_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.count("*").alias("n")]
    out = timed.groupBy(*keys, F.window("ts", f"{width_ms} milliseconds")).agg(*stats)
    return out.select(*keys, F.unix_millis("window.start").alias("bucket_ms"), "avg_value", "min_value", "max_value", "n")


def hourly(readings: DataFrame, late: str = "1 hour") -> DataFrame:
    """Hours of every sensor."""
    return buckets(readings, HOUR_MS, late)


def daily(readings: DataFrame, late: str = "1 day", keys: Sequence[str] = ("sensor_id",)) -> DataFrame:
    """UTC days by the keys: a zone and type, if the readings have been joined to their zones."""
    return buckets(readings, DAY_MS, late, keys)


def first_breach(readings: DataFrame, threshold: float, min_duration_ms: int, late: str = "1 hour") -> DataFrame:
    """Every run above the threshold that lasted long enough, told once it is over, with its true end and peak.

    A run is over when a reading at or below the threshold follows, or when the
    watermark, ``late`` behind the latest reading of all, has passed its last
    reading by ``late``; then the sensor's state goes as well. Within a batch readings are sorted; those from
    before what a sensor has reached are left out, as they can't change a run told.
    """
    wait_ms = int(pd.Timedelta(late).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, above, start, end, peak = state.get if state.exists else (-(1 << 62), False, 0, 0, 0.0)
        out = []

        def over() -> None:
            if above and end - start >= min_duration_ms:
                out.append((key[0], start, end, end - start, peak))

        if state.hasTimedOut:
            over()
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(["ts_ms", "value"])
            for ts, value in zip(rows.ts_ms.tolist(), rows.value.tolist(), strict=True):
                if ts < seen:
                    continue
                seen = ts
                if not value > threshold:
                    over()
                    above = False
                elif not above:
                    above, start, end, peak = True, ts, ts, value
                else:
                    end, peak = ts, max(peak, value)
            state.update((seen, above, start, end, peak))
            state.setTimeoutTimestamp(max(seen, state.getCurrentWatermarkMs()) + wait_ms + 1)
        yield pd.DataFrame(out, columns=["sensor_id", "start_ts", "end_ts", "duration_ms", "peak_value"])

    timed = readings.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", late)
    return timed.groupBy("sensor_id").applyInPandasWithState(
        step, "sensor_id long, start_ts long, end_ts long, duration_ms long, peak_value double", "seen long, above boolean, start long, end long, peak double", "append", GroupStateTimeout.EventTimeTimeout
    )


def ring(readings: DataFrame, n: int = RING_CAPACITY) -> DataFrame:
    """Each sensor's last n readings by arrival, as lists; state is bounded by n."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, values = state.get if state.exists else ([], [])
        rows = pd.concat(list(batches))
        times = [*times, *rows.ts_ms.tolist()][-n:]
        values = [*values, *rows.value.tolist()][-n:]
        state.update((times, values))
        yield pd.DataFrame({"sensor_id": [key[0]], "ts_ms": [times], "values": [values]})

    fields = "ts_ms array<long>, values array<double>"
    return readings.groupBy("sensor_id").applyInPandasWithState(step, f"sensor_id long, {fields}", fields, "update", GroupStateTimeout.NoTimeout)


def sink(readings: DataFrame, layout, checkpoint: str, retention_days: Mapping[str, int] | None = None):
    """Insert every batch into a layout, once even if it is replayed; the query that does so.

    With retention_days, by type, what is older than that before the batch's latest reading goes after each insert.
    """

    stream = hashlib.md5(checkpoint.encode()).hexdigest()

    def write(batch: DataFrame, number: int) -> None:
        layout.insert(batch, source=f"{stream}-{number}")
        now = batch.agg(F.max("ts_ms")).first()[0] if retention_days else None
        if now is not None:
            layout.prune_by_age({t: now - days * DAY_MS for t, days in retention_days.items()})

    return readings.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
