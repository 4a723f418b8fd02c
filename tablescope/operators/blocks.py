"""Very wide headers: columns in blocks, aggregated by block.

An aggregate with several buffers for each of thousands of columns exceeds the number of fields up to which Spark compiles
a stage. Above BLOCK columns a row is therefore laid out as one short row per block of columns, in one pass, and
the aggregate of a block's few columns is merged by (keys, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a block: with eight buffers each they stay below 100 fields.
BLOCK = 12


def in_blocks(df: DataFrame, keys: list[Column], size: int = BLOCK, **kinds: list[Column]) -> tuple[DataFrame, int]:
    """(rows of keys, ``_b``, ``_one``, and ``{kind}{j}`` for the j-th column of block ``_b``; number of columns in a block).

    ``kinds``: for each kind of value one Column per profiled column, all of one type; ``_one`` counts the row. Each block also has a
    row that counts 0 and holds nothing, if there are no keys, so that an empty table still has all blocks."""
    n = len(next(iter(kinds.values())))
    width = min(n, size)
    if n <= size:
        rows = df.select(*keys, F.lit(0).alias("_b"), F.lit(1).alias("_one"), *[c.alias(f"{k}{j}") for k, cs in kinds.items() for j, c in enumerate(cs)])
    else:
        # Values get names first, so that null columns can fill up the last block with the right types.
        named = df.select(*keys, *[c.alias(f"_{k}_{i}") for k, cs in kinds.items() for i, c in enumerate(cs)])
        types = {k: named.schema[f"_{k}_0"].dataType for k in kinds}
        cell = lambda k, i: F.col(f"_{k}_{i}") if i < n else F.lit(None).cast(types[k])
        parts = [F.struct(F.lit(b).alias("_b"), F.lit(1).alias("_one"), *[cell(k, b * size + j).alias(f"{k}{j}") for k in kinds for j in range(size)])
                 for b in range(-(-n // size))]
        rows = named.select(*named.columns[:len(keys)], F.inline(F.array(*parts)))
    if not keys:
        nothing = df.sparkSession.range(-(-n // size)).select(
            F.col("id").cast("int").alias("_b"), F.lit(0).alias("_one"),
            *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns[2:]])
        rows = rows.unionByName(nothing)
    return rows, width
