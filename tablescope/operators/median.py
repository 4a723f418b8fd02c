"""Exact median per group by counting, without holding a group's values in one task.

``F.median`` keeps a value→count map per group and merges all of a global column's maps in
one final task, which does not hold at 100 TB. Here the two middle ranks are bracketed from
the rows themselves:

1. Each round cuts every open group's bracket [lo, hi] into buckets and counts the rows of each
   bucket (a partial aggregate: a task sends at most one row per group and bucket, whatever its
   rows). The first round cuts evenly in log(1 + |x|), so that heavy tails don't hold all rows
   in one bucket; later rounds cut evenly in x. The ends of a bracket are buckets of their own.
2. The bucket that holds the middle ranks, by running counts, is the next bracket, with the least
   and greatest value found in it as its ends. Ranks that fall in two buckets, or a bracket of one
   value, end the group's search.
3. A group leaves the rounds as soon as its bracket holds at most ``finish_rows`` rows (a small group at once).
   After the last round one pass counts the values inside the brackets of all these groups, and the middle ones are
   picked in value order.

The plan is the same at every size; only the number of rounds grows, by the logarithm of the largest
group's rows, and only groups above ``finish_rows`` take part in a round. State is one row per open group: it is broadcast when its size is small and
shuffled by group otherwise. The result is exact (mean of the two middle values for an even count).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import qcol
from ..session import checkpoint as _ckpt

DEFAULT_BUCKETS = 4096
FINISH_ROWS = 50_000
_STATE_ROW_BYTES = 128
_BROADCAST_BYTES = 32 << 20
_LARGEST = 1.7976931348623157e308  # infinite ends are cut here; their values still have end buckets


def _bucket(x: Column, first: bool, buckets: int) -> Column:
    """0 for the bracket's least value, buckets + 1 for its greatest, 1..buckets between (non-decreasing in x)."""
    lo, hi = F.greatest(F.col("lo"), F.lit(-_LARGEST)), F.least(F.col("hi"), F.lit(_LARGEST))
    at = (lambda v: F.signum(v) * F.log1p(F.abs(v))) if first else (lambda v: v / 2)
    share = F.coalesce(F.try_divide(at(x) - at(lo), at(hi) - at(lo)), F.lit(0.0))
    inner = F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * buckets)
    return (F.when(x == F.col("lo"), F.lit(0)).when(x == F.col("hi"), F.lit(buckets + 1))
            .otherwise(1 + F.least(inner, F.lit(buckets - 1))).cast("int"))


def _inside(rows: DataFrame, state: DataFrame, g: list[str], groups: int) -> DataFrame:
    """Rows within their group's open bracket, with the bracket (a NULL key equals NULL)."""
    cols = ("lo", "hi", "below", "r1", "r2")
    s = state.select(*[qcol(k).alias(f"_s{i}") for i, k in enumerate(g)], *cols)
    if groups * _STATE_ROW_BYTES <= _BROADCAST_BYTES:
        s = F.broadcast(s)
    on = [qcol(k).eqNullSafe(F.col(f"_s{i}")) for i, k in enumerate(g)]
    joined = rows.join(s, on) if g else rows.join(s)
    return joined.where((F.col("_x") >= F.col("lo")) & (F.col("_x") <= F.col("hi"))) \
        .select(*[qcol(k) for k in g], "_x", "_w", *cols)


def _select(counts: DataFrame, g: list[str], order: str) -> tuple[DataFrame, Column, Column]:
    """Running counts before each row of ``counts``, and whether it holds the middle ranks."""
    w = Window.partitionBy(*[qcol(k) for k in g]).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("_before", F.col("below") + F.coalesce(F.sum("_n").over(w), F.lit(0)))
    holds = [(F.col("_before") <= F.col(r)) & (F.col(r) < F.col("_before") + F.col("_n")) for r in ("r1", "r2")]
    return ranked, holds[0], holds[1]


def exact_median(long_df: DataFrame, group_cols, value_col: str = "value", weight_col: str | None = None,
                 buckets: int = DEFAULT_BUCKETS, finish_rows: int = FINISH_ROWS) -> DataFrame:
    """(group_cols..., median DOUBLE) over non-null values of ``value_col``.

    ``weight_col``: rows stand for that many copies of their value (used to add filled cells
    without materialising them). Groups with no values are absent; callers left-join. ``long_df`` is
    read once per round, so it should be cheap to recompute (a scan) or already written.
    """
    g = list(group_cols)
    keys = [qcol(k) for k in g]
    weight = F.col(weight_col).cast("bigint") if weight_col else F.lit(1).cast("bigint")
    rows = long_df.select(*keys, F.col(value_col).cast("double").alias("_x"), weight.alias("_w")) \
        .where(F.col("_x").isNotNull() & (F.col("_w") > 0))
    state = _ckpt(rows.groupBy(*keys).agg(F.sum("_w").alias("_n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
                  .where("_n > 0").select(
        *keys, "lo", "hi", F.lit(0).cast("bigint").alias("below"), F.floor((F.col("_n") - 1) / 2).alias("r1"),
        F.floor(F.col("_n") / 2).alias("r2"), F.col("_n").alias("inside"),
        F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("median")))
    results, waiting, first = [], [], True
    while True:
        results.append(state.where(F.col("median").isNotNull()).select(*keys, "median"))
        left = state.where(F.col("median").isNull())
        n_small, n_open = left.agg(F.count_if(F.col("inside") <= finish_rows), F.count_if(F.col("inside") > finish_rows)).first()
        if n_small:
            # Their brackets hold few rows: they wait for the one pass that finishes all such groups.
            waiting.append((left.where(F.col("inside") <= finish_rows).select(*keys, "lo", "hi", "below", "r1", "r2"), n_small))
        if not n_open:
            break
        left = left.where(F.col("inside") > finish_rows)
        hist = (_inside(rows, left, g, n_open).withColumn("_b", _bucket(F.col("_x"), first, buckets))
                .groupBy(*keys, "_b", "below", "r1", "r2")
                .agg(F.sum("_w").alias("_n"), F.min("_x").alias("_min"), F.max("_x").alias("_max")))
        ranked, one, two = _select(hist, g, "_b")
        at = lambda hit, c: F.max(F.when(hit, F.col(c)))
        state = _ckpt(ranked.where(one | two).groupBy(*keys, "r1", "r2").agg(
            at(one, "_min").alias("lo"), at(one, "_max").alias("hi"), at(two, "_min").alias("_lo2"),
            F.min("_before").alias("below"), at(one, "_n").alias("inside")).select(
            *keys, "lo", "hi", "below", "r1", "r2", "inside",
            F.when(F.col("lo") != F.col("_lo2"), (F.col("hi") + F.col("_lo2")) / 2)
            .when(F.col("lo") == F.col("hi"), F.col("lo")).alias("median")))
        first = False
    if waiting:
        brackets = reduce(DataFrame.unionByName, [w for w, _ in waiting])
        counts = _inside(rows, brackets, g, sum(n for _, n in waiting)).groupBy(*keys, "_x", "below", "r1", "r2").agg(F.sum("_w").alias("_n"))
        ranked, one, two = _select(counts, g, "_x")
        results.append(ranked.where(one | two).groupBy(*keys).agg(
            ((F.max(F.when(one, F.col("_x"))) + F.max(F.when(two, F.col("_x")))) / 2).alias("median")))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out
