"""Distinct counts and most common values of text columns, with values known by their hash.

Whole values never enter a shuffle or a checkpoint: a value is counted as 128 bits of two hashes, combined on the map
side. A third hash rides along as its least and greatest per group; where the two differ, different values
share the 128 bits, and those values alone are counted again by their text. (Two values that agree in all 192 bits would
count as one.) The most common value of a group is looked up by its hash: every task sends at most one
text per group, the least of those that reach the group's top count. If too many values are tied to be
broadcast (a column of unique texts, say), bytes from the front of the tied values, as numbers, narrow them down first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import qcol
from ..session import checkpoint as _ckpt

BROADCAST_BYTES = 32 << 20
_ROW_BYTES = 64
_FEW = 4096
NARROWING = 8  # rounds at most, of _STEP bytes each
_STEP = 7  # bytes of a value that fit a positive 64-bit number


def _hashes(bits: int) -> list[Column]:
    cut = lambda h: h if bits >= 64 else h.bitwiseAND(F.lit((1 << bits) - 1))
    v = F.col("value")
    return [F.when(v.isNotNull(), cut(F.xxhash64(v))).alias("_h1"), F.when(v.isNotNull(), cut(F.xxhash64(F.lit(1), v))).alias("_h2")]


def _front(value: Column, step: int) -> Column:
    """Bytes ``step * 7 …`` of a value as a number that sorts like them (bytes past the end sort first)."""
    part = F.hex(F.substring(value.cast("binary"), step * _STEP + 1, _STEP))
    return F.conv(F.rpad(part, 2 * _STEP, "0"), 16, 10).cast("bigint")


def _same(keys: list[str], prefix: str):
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & qcol(k).eqNullSafe(F.col(f"{prefix}{i}"))
    return on


def _renamed(df: DataFrame, keys: list[str], prefix: str, *rest) -> DataFrame:
    return df.select(*[qcol(k).alias(f"{prefix}{i}") for i, k in enumerate(keys)], *rest)


def count_values(values: DataFrame, keys, bits: int = 64) -> DataFrame:
    """(keys..., _h1, _h2, _text, n), as a written table: one row per distinct value of a group (hashes null for missing
    ones). ``_text`` is null but where values that share their hashes had to be told apart."""
    ks = [qcol(k) for k in keys]
    check = F.xxhash64(F.lit(2), F.col("value"))
    counts = _ckpt(values.select(*ks, *_hashes(bits), check.alias("_c")).groupBy(*ks, "_h1", "_h2")
                   .agg(F.count(F.lit(1)).alias("n"), F.min("_c").alias("_lo"), F.max("_c").alias("_hi")))
    plain = counts.select(*ks, "_h1", "_h2", F.lit(None).cast("string").alias("_text"), "n")
    clash = counts.where(F.col("_h1").isNotNull() & (F.col("_lo") != F.col("_hi"))).select(*ks, "_h1", "_h2")
    if not clash.take(1):
        return plain
    c = _renamed(clash, keys, "_q", F.col("_h1").alias("_q_1"), F.col("_h2").alias("_q_2"))
    on = _same(keys, "_q") & (F.col("_h1") == F.col("_q_1")) & (F.col("_h2") == F.col("_q_2"))
    told = (values.select(*ks, "value", *_hashes(bits)).join(c, on, "left_semi")
            .groupBy(*ks, "_h1", "_h2", F.col("value").alias("_text")).agg(F.count(F.lit(1)).alias("n")))
    return _ckpt(plain.join(c, on, "left_anti").unionByName(told))


def most_common(values: DataFrame, keys, bits: int = 64, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(keys..., top, top_n, unique_values, missing) from ``values`` = (keys..., value): the most frequent non-null
    value, ties to the smallest, its count (0 when there is none), the number of distinct values and
    of missing ones. ``values`` is read once for the counts and again for the winners' texts, so it should be
    cheap to read (a scan, or a written table)."""
    keys = list(keys)
    ks = [qcol(k) for k in keys]
    counts = count_values(values, keys, bits)
    there = F.col("_h1").isNotNull()
    best = _ckpt(counts.groupBy(*ks).agg(
        F.coalesce(F.max(F.when(there, F.col("n"))), F.lit(0)).alias("top_n"), F.count("_h1").alias("unique_values"),
        F.coalesce(F.sum(F.when(~there, F.col("n"))), F.lit(0)).alias("missing")))
    b = _renamed(best, keys, "_b", F.col("top_n").alias("_bn"))
    tied = _ckpt(counts.where(there).join(b, _same(keys, "_b") & (F.col("n") == F.col("_bn"))).select(*ks, "_h1", "_h2", "_text"))
    known = tied.where(F.col("_text").isNotNull()).select(*ks, F.col("_text").alias("value"))
    tied = tied.where(F.col("_text").isNull()).select(*ks, "_h1", "_h2")
    hashed = values.where(F.col("value").isNotNull()).select(*ks, "value", *_hashes(bits))
    n = tied.count()
    for step in range(NARROWING):
        if n * _ROW_BYTES <= broadcast_bytes:
            break
        # Too many to broadcast: keep, in each group, the values whose next bytes are least. Hashes and numbers move, not texts.
        tied = _narrow(hashed.select(*ks, "_h1", "_h2", _front(F.col("value"), step).alias("_p")), tied, keys)
        n = tied.count()
    t = _renamed(tied, keys, "_q", F.col("_h1").alias("_q_1"), F.col("_h2").alias("_q_2"))
    if n * _ROW_BYTES <= broadcast_bytes:
        t = F.broadcast(t)  # else values that agree in their first bytes, of which the join shuffles what is tied
    on = _same(keys, "_q") & (F.col("_h1") == F.col("_q_1")) & (F.col("_h2") == F.col("_q_2"))
    found = hashed.join(t, on, "left_semi").select(*ks, "value")
    if n > _FEW:
        # A minimum of texts is a sorting aggregate: the least first bytes, a plain number, leave it few rows.
        least = _renamed(_ckpt(found.groupBy(*ks).agg(F.min(_front(F.col("value"), 0)).alias("_m"))), keys, "_l", "_m")
        found = found.join(least, _same(keys, "_l") & (_front(F.col("value"), 0) == F.col("_m")), "left_semi")
    top = _renamed(found.unionByName(known).groupBy(*ks).agg(F.min("value").alias("top")), keys, "_t", "top")
    return best.join(top, _same(keys, "_t"), "left").select(*ks, "top", "top_n", "unique_values", "missing")


def _narrow(fronts: DataFrame, tied: DataFrame, keys: list[str]) -> DataFrame:
    ks = [qcol(k) for k in keys]
    t = _renamed(tied, keys, "_q", F.col("_h1").alias("_q_1"), F.col("_h2").alias("_q_2"))
    on = _same(keys, "_q") & (F.col("_h1") == F.col("_q_1")) & (F.col("_h2") == F.col("_q_2"))
    kept = _ckpt(fronts.groupBy(*ks, "_h1", "_h2").agg(F.min("_p").alias("_p")).join(t, on, "left_semi"))
    least = _renamed(kept.groupBy(*ks).agg(F.min("_p").alias("_m")), keys, "_l", "_m")
    return _ckpt(kept.join(least, _same(keys, "_l") & (F.col("_p") == F.col("_m"))).select(*ks, "_h1", "_h2"))
