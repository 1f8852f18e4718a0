"""Random numbers as expressions: the same for the same seed and keys, however rows are partitioned."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int | Column, *keys: str | Column) -> Column:
    """In [0, 1), from the top 53 bits of a hash."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    bits = F.shiftrightunsigned(F.xxhash64(seed, *keys), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def normal(seed: int, *keys: str | Column) -> Column:
    """Standard normal by Box and Muller."""
    u, v = uniform(F.lit(2 * seed), *keys), uniform(F.lit(2 * seed + 1), *keys)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(F.lit(2 * math.pi) * v)
