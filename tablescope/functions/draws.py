"""Repeatable random draws keyed by row id (independent of partitioning).

u(id, tag, seed) = first 8 hex digits of md5('seed:tag:id') as an unsigned int / 2**32,
a uniform value in [0, 1). The same draw is expressible in plain SQL, so generated
tables have an oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform01(id_col: Column, tag: str, seed: int) -> Column:
    key = F.concat(F.lit(f"{seed}:{tag}:"), id_col.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def rand_int(u: Column, lo: int, hi: int) -> Column:
    """Uniform integer in [lo, hi], both ends included."""
    return (F.floor(u * (hi - lo + 1)) + lo).cast("bigint")


def round2(x: Column) -> Column:
    """Two-decimal rounding, half away from zero on x*100 (positive draws)."""
    return F.floor(x * 100 + 0.5) / 100


def rand_real2(u: Column, lo: float, hi: float) -> Column:
    """Uniform real in [lo, hi] rounded to two decimals."""
    return round2(F.lit(float(lo)) + u * F.lit(float(hi - lo)))


def pick(u: Column, choices) -> Column:
    """Uniform pick from a fixed list."""
    arr = F.array(*[F.lit(v) for v in choices])
    return F.element_at(arr, (F.floor(u * len(choices)) + 1).cast("int"))
