"""Latencies of a call: one warm-up, then timed runs."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class LatencyStats:
    iterations: int
    median_ns: int
    p95_ns: int
    p99_ns: int
    min_ns: int
    max_ns: int
    mean_ns: int
    total_ns: int

    @property
    def throughput(self) -> float:
        """Calls a second, 0 if no time passed."""
        return self.iterations / (self.total_ns / 1e9) if self.total_ns > 0 else 0.0

    def line(self, name: str) -> str:
        return f"{name}: median {self.median_ns / 1000:.1f} us, p95 {self.p95_ns / 1000:.1f} us, p99 {self.p99_ns / 1000:.1f} us, {self.throughput:.1f} calls/s"


def summarise(samples: list[int]) -> LatencyStats:
    """Percentiles are samples by rank: n/2, 95n/100, 99n/100, the last at most."""
    if not samples:
        return LatencyStats(0, 0, 0, 0, 0, 0, 0, 0)
    s, n = sorted(samples), len(samples)
    at = lambda i: s[min(i, n - 1)]
    return LatencyStats(n, at(n // 2), at(n * 95 // 100), at(n * 99 // 100), s[0], s[-1], sum(s) // n, sum(s))


def force(df: DataFrame) -> None:
    """Run a query in full and keep nothing."""
    df.write.format("noop").mode("overwrite").save()


def time_query(call: Callable[[int], DataFrame], iterations: int) -> LatencyStats:
    """call: the query of the i-th run, so that arguments can cycle."""
    force(call(0))
    samples = []
    for i in range(iterations):
        began = time.perf_counter_ns()
        force(call(i))
        samples.append(time.perf_counter_ns() - began)
    return summarise(samples)
