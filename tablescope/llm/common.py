"""Small shared helpers: table reading, row packing and row-exact filtering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.session import checkpoint, ship_package  # noqa: F401  (checkpoint: for the operators)

#: White space that separates words: space and the five control characters tab..CR.
SPACE = r"[\x20\x09-\x0D]+"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A table is broadcast only when its estimated size stays below this many bytes.
BROADCAST_BYTES = 32 << 20
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Before Python tasks run: executors get the package, and documents travel in batches of BATCH_ROWS rows
    (Spark's own 10,000 hold tens of megabytes of text, twice, in every task). A smaller setting stays."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def packed(df: DataFrame, name: str = "row") -> DataFrame:
    """All columns as one struct, so that no column of the caller clashes with a working column."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def unpacked(df: DataFrame, columns: list[str], name: str = "row") -> DataFrame:
    return df.select(*[F.col(name).getField(c).alias(c) for c in columns])


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text: ASCII letters lower-cased, split at white space, no empty words."""
    lowered = F.translate(text, ASCII_UPPER, ASCII_LOWER)
    return F.filter(F.split(lowered, SPACE), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df``, a written table, marked for broadcast if its rows are few enough; else it will be shuffled."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def text_key(column: str = "text") -> Column:
    return F.xxhash64(text_of(column))


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose (doc_id, text_key) is in ``dropped`` (doc_id, k).

    Null-safe on doc_id and row-exact: two rows with one doc_id and different texts are
    judged apart. Only the keys of dropped rows are shuffled or broadcast beside ``docs``.
    """
    rows = packed(docs).withColumns({"k_id": F.col("row.doc_id"), "k_key": text_key("row.text")})
    gone = checkpoint(dropped.select(F.col("doc_id").alias("g_id"), F.col("k").alias("g_key")).distinct())
    kept = rows.join(if_small(gone, 64), F.col("k_id").eqNullSafe(F.col("g_id")) & (F.col("k_key") == F.col("g_key")), "left_anti")
    return unpacked(kept, docs.columns)
