"""Operator 10, sharding by histogram sort under the ``bytes`` law.

Rows are ordered by (hash of the text, doc_id), so equal texts are neighbours. Splitters for near
equal byte sums are found by counting: in each round every task counts the exact bytes and rows
between probes, the driver adds up a bounded histogram (probes, not rows) and lays new probes
inside the interval that holds each splitter's target, until the bytes below the splitter are
within tolerance. A splitter falls between texts; only where one text alone (a hot group of
copies) exceeds the tolerance is it refined inside the group, by doc_id. Then rows go
once to their place: fine ranges inside a shard bound a task, and because the histogram has exact
row counts below every fine range, slots are gapless without one task per shard.

Defined results: a null text counts as empty (size 1, crc 0); a null doc_id sorts first; rows that repeat
doc_id and text stay on one side of a splitter. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablescope.llm.common import checkpoint, prepare, read, text_of

SHARDS = 16
TOLERANCE = 0.001       # of a shard's share of the bytes, for a shard's splitter
WHOLE = 0.01            # of a shard's share: a group of equal texts is split only beyond this (or half the largest row)
FINE_TOLERANCE = 0.25   # of a fine range's share, for the splitters inside a shard
FINE_ROWS = 4 << 20     # rows (without their texts) of a fine range, one task's share of the exchange
FINE_LEAST = 4          # fine ranges of a shard, at least
PROBES = 64             # probes laid in an open interval in a round, and
ALL_PROBES = 1 << 18    # in all open intervals together (two at least in each)
_TOP = 1 << 62          # above every hash
_LEAST_ID = -(1 << 63)


@dataclass
class Splitter:
    """The search for one splitter. Rows below ``lo`` have ``lo_at`` (bytes, rows); rows below ``hi``
    have ``hi_at``. ``group`` is set once the search goes on by doc_id inside one text's group."""

    target: float
    tolerance: float  # near enough to stop
    whole: float  # a text's group is split only if both its ends are further away than this
    lo: int
    hi: int
    lo_at: tuple[int, int]
    hi_at: tuple[int, int]
    ids: tuple[int, int]  # least and largest doc_id
    group: int | None = None
    done: tuple[int, int] | None = None  # (hash, doc_id): the first key above the splitter
    at: tuple[int, int] = (0, 0)
    laid: list[tuple[int, int]] = field(default_factory=list)

    def settle(self) -> None:
        """Close the search if an end is near enough or no key lies between the ends."""
        ends = ((self.lo, self.lo_at), (self.hi, self.hi_at))
        key, at = min(ends, key=lambda e: abs(e[1][0] - self.target))
        near = abs(at[0] - self.target) <= self.tolerance
        last = self.hi - self.lo <= 1 or self.hi_at[1] - self.lo_at[1] <= 1
        if (last and not near and self.group is None and self.hi_at[1] - self.lo_at[1] > 1
                and abs(at[0] - self.target) > self.whole):
            # One text's rows lie between the ends: go on inside the group.
            self.group, self.lo, self.hi = self.lo, self.ids[0], self.ids[1] + 1
        elif near or last:
            inside = self.group is not None and self.ids[0] < key <= self.ids[1]
            self.done = (self.group, key) if inside else (key if self.group is None else self.group + (key > self.ids[0]), _LEAST_ID)
            self.at = at

    def lay(self, probes: int) -> list[tuple[int, int]]:
        step = max(1, -(-(self.hi - self.lo) // probes))
        inner = range(self.lo + step, self.hi, step)
        self.laid = [(p, _LEAST_ID) if self.group is None else (self.group, p) for p in inner]
        return self.laid

    def learn(self, below: dict[tuple[int, int], tuple[int, int]]) -> None:
        for (h, d) in self.laid:
            key = h if self.group is None else d
            at = below[(h, d)]
            if at[0] <= self.target and key > self.lo:
                self.lo, self.lo_at = key, at
            elif at[0] > self.target and key < self.hi:
                self.hi, self.hi_at = key, at
        self.settle()


def _place(h: np.ndarray, d: np.ndarray, keys: list[tuple[int, int]]) -> np.ndarray:
    """For each row the number of sorted ``keys`` (hash, doc_id) that are not above it."""
    kh = np.array([k[0] for k in keys], dtype=np.int64)
    kd = np.array([k[1] for k in keys], dtype=np.int64)
    low, high = np.searchsorted(kh, h, side="left"), np.searchsorted(kh, h, side="right")
    out = low.copy()
    tied = np.flatnonzero(low < high)
    for a in np.unique(low[tied]):  # one pass for each key's hash that rows share
        rows = tied[low[tied] == a]
        out[rows] = a + np.searchsorted(kd[a:high[rows[0]]], d[rows], side="right")
    return out


def _histogram(rows: DataFrame, keys: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows below each of the sorted ``keys``."""
    def count(batches):
        size, n = np.zeros(len(keys) + 1, dtype=np.int64), np.zeros(len(keys) + 1, dtype=np.int64)
        for b in batches:
            at = _place(b["h"].to_numpy(), b["d"].to_numpy(), keys)
            np.add.at(size, at, b["size"].to_numpy())
            n += np.bincount(at, minlength=len(keys) + 1)
        hit = np.flatnonzero(n)
        yield pd.DataFrame({"bin": hit, "bytes": size[hit], "n": n[hit]})

    found = (rows.select("h", "d", "size").mapInPandas(count, "bin long, bytes long, n long")
             .groupBy("bin").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect())  # at most a row for each probe
    size, n = np.zeros(len(keys) + 1, dtype=np.int64), np.zeros(len(keys) + 1, dtype=np.int64)
    for r in found:
        size[r["bin"]], n[r["bin"]] = r["bytes"], r["n"]
    return np.cumsum(size)[:-1], np.cumsum(n)[:-1]


def find_splitters(rows: DataFrame, shards: int = SHARDS, fine: int | None = None,
                   tolerance: float = TOLERANCE) -> tuple[list[Splitter], int]:
    """Splitters between ``shards * fine`` ranges of near equal bytes, and ``fine``."""
    total = rows.agg(F.sum("size").alias("s"), F.max("size").alias("most"), F.count(F.lit(1)).alias("n"),
                     F.min("d").alias("d0"), F.max("d").alias("d1")).first()
    size, n, most = int(total["s"] or 0), int(total["n"]), int(total["most"] or 0)
    if fine is None:
        fine = int(max(FINE_LEAST, -(-n // (shards * FINE_ROWS))))
    share = size / (shards * fine)
    whole = max(share * fine * WHOLE, most / 2)  # no splitter can promise more than half the largest row
    found = [Splitter(share * i, share * fine * tolerance if i % fine == 0 else share * FINE_TOLERANCE, whole, 0, _TOP, (0, 0), (size, n),
                      (total["d0"], total["d1"])) for i in range(1, shards * fine)]
    while n and (left := [s for s in found if s.done is None]):
        probes = max(2, min(PROBES, ALL_PROBES // len(left)))
        keys = sorted({p for s in left for p in s.lay(probes)})
        bytes_below, rows_below = _histogram(rows, keys)
        below = {k: (int(b), int(r)) for k, b, r in zip(keys, bytes_below, rows_below)}
        for s in left:
            s.learn(below)
    return found, fine


def shard_rows(docs: DataFrame, shards: int = SHARDS, fine: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, fine_range for every row of ``docs``."""
    prepare(docs.sparkSession)
    text = text_of().cast("binary")
    rows = checkpoint(docs.select(
        "doc_id", F.shiftrightunsigned(F.xxhash64(text), 2).alias("h"), F.coalesce("doc_id", F.lit(_LEAST_ID)).alias("d"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")))
    found, fine = find_splitters(rows, shards, fine, tolerance)
    keys = [s.done or (_TOP, _LEAST_ID) for s in found]
    keys = [max(keys[: i + 1]) for i in range(len(keys))]  # in order, also where two fell on one place
    starts = [0, *(s.at[1] for s in found)]  # rows below each range
    starts = [max(starts[: i + 1]) for i in range(len(starts))]

    @F.pandas_udf("int")
    def range_of(h: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(_place(h.to_numpy(), d.to_numpy(), keys).astype(np.int32))

    offset = F.get(F.array(*[F.lit(starts[i] - starts[i - i % fine]).cast("long") for i in range(len(starts))]), F.col("fine_range"))
    # The one exchange: every row goes to its fine range, and is numbered there in key order.
    order = Window.partitionBy("fine_range").orderBy("h", "d")
    return (rows.withColumn("fine_range", range_of("h", "d"))
            .withColumn("nth", F.row_number().over(order))
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"),
                    F.floor(F.col("fine_range") / fine).cast("int").alias("shard"),
                    (offset + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
                    "fine_range"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(read(spark, sf_dir, "documents")).drop("fine_range")
