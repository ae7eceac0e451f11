"""Random columns that depend on a row's key alone, so retries and repartitioning change nothing."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column, seed: str) -> Column:
    """[0, 1) from the first 32 bits of md5(key|seed)."""
    word = F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}"))), 1, 8)
    return F.conv(word, 16, 10).cast("double") / 4294967296.0


def normal(key: Column, seed: str) -> Column:
    """Standard normal by Box-Muller from two streams."""
    u, v = uniform(key, f"{seed}a"), uniform(key, f"{seed}b")
    return F.sqrt(-2.0 * F.ln(1.0 - u)) * F.cos(2.0 * math.pi * v)
