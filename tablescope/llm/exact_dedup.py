"""Operator 3, exact dedup by content-defined chunk recipes (DataFrame functions only).

A text is cut into chunks at places its own content defines. Each chunk gets a verified
identifier: its 64-bit fingerprint, plus a variant number wherever the distinct chunks of the
whole corpus show that two different contents share a fingerprint. A text is then the ordered
list of its chunk identifiers (its recipe); equal recipes mean equal texts. Chunk contents are
shuffled once, as distinct chunks after a map-side combine; from then on only recipes move
(about 8 bytes for 600 characters), however long or often repeated a document is.

Defined results: a null text counts as empty, the empty text has the empty recipe; of equal
texts the row with the largest doc_id stays (a null doc_id is smallest), and of rows that
repeat doc_id and text exactly one stays. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablescope.llm.common import checkpoint, packed, read, text_key, text_of, unpacked, without

CHUNK_MIN, CHUNK_MAX = 512, 4096


def chunks_of(text, least: int = CHUNK_MIN, most: int = CHUNK_MAX):
    """Cut after the first sentence end or line end beyond ``least`` characters, at ``most`` at the
    latest. The cuts depend on nearby content only, and the chunks concatenate to the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most}}}?(?<=[\n.!?])|.{{1,{most}}}"), F.lit(0))


def fingerprint(chunk, bits: int = 64):
    h = F.xxhash64(chunk)
    return h if bits >= 64 else h.bitwiseAND(F.lit((1 << bits) - 1))


def verified_recipes(docs: DataFrame, least: int = CHUNK_MIN, most: int = CHUNK_MAX, bits: int = 64) -> DataFrame:
    """(doc_id, text_sha256, row_no, recipe) for every row of ``docs``, written once as a table.

    ``bits`` shortens the fingerprint; tests use it to force the collisions that 64 bits
    hardly ever show. Row numbers are stable because they are read back from the table."""
    src = docs.select("doc_id", text_of().alias("text"))
    pieces = src.select(F.explode(F.array_distinct(chunks_of(F.col("text"), least, most))).alias("chunk"))
    pieces = pieces.select(fingerprint(F.col("chunk"), bits).alias("fp"), "chunk").distinct()
    clashing = checkpoint(pieces.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fp"))
    base = src.select(
        "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.xxhash64("text").alias("k"),
        F.monotonically_increasing_id().alias("row_no"),
        F.transform(chunks_of(F.col("text"), least, most), lambda c: fingerprint(c, bits)).alias("recipe"))
    if clashing.isEmpty():  # every fingerprint stands for one content: it is the identifier
        return checkpoint(base)
    variant = Window.partitionBy("fp").orderBy("chunk")
    variants = pieces.join(clashing, "fp").withColumn("variant", F.row_number().over(variant))
    parts = src.select(F.col("text")).distinct().select(
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
        F.posexplode(chunks_of(F.col("text"), least, most)).alias("pos", "chunk"))
    parts = parts.withColumn("fp", fingerprint(F.col("chunk"), bits))
    exact = (parts.join(variants, ["fp", "chunk"], "left")
             .groupBy("text_sha256")
             .agg(F.sort_array(F.collect_list(F.struct("pos", "fp", F.coalesce("variant", F.lit(0)).alias("variant")))).alias("exact")))
    return checkpoint(base.drop("recipe").join(exact, "text_sha256", "left").withColumnRenamed("exact", "recipe"))


def exact_dedup(docs: DataFrame, least: int = CHUNK_MIN, most: int = CHUNK_MAX, bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_chunks."""
    base = verified_recipes(docs, least, most, bits)
    base = base.withColumn("recipe", F.coalesce("recipe", F.array().cast(base.schema["recipe"].dataType)))
    order = F.coalesce("doc_id", F.lit(-(1 << 63)))
    groups = checkpoint(base.groupBy("recipe").agg(
        F.max("doc_id").alias("keep_id"), F.max_by("row_no", order).alias("keep_row"),
        F.count(F.lit(1)).alias("group_size")).filter("group_size > 1"))
    # The join deals both sides out afresh, so that AQE can split a recipe that a third of the rows have.
    return base.join(groups, "recipe", "left").select(
        "doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row_no") == F.col("keep_row"), F.lit(True)).alias("kept"),
        "text_sha256", F.size("recipe").alias("n_chunks"), "k")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns unchanged."""
    marks = checkpoint(exact_dedup(docs).select("doc_id", "k", "kept"))
    gone, stays = marks.filter("NOT kept").select("doc_id", "k"), marks.filter("kept").select("doc_id", "k")
    twins = checkpoint(gone.join(stays, gone.doc_id.eqNullSafe(stays.doc_id) & (gone.k == stays.k), "left_semi").distinct())
    kept = without(docs, gone)
    if twins.isEmpty():
        return kept
    # Rows that repeat doc_id and text: one of each comes back, by the hash of the whole row, so that a task run again
    # brings back the same one.
    t = twins.select(F.col("doc_id").alias("t_id"), F.col("k").alias("t_key"))
    again = packed(docs).withColumns({"k_id": F.col("row.doc_id"), "k_key": text_key("row.text")})
    again = again.join(t, F.col("k_id").eqNullSafe(F.col("t_id")) & (F.col("k_key") == F.col("t_key")), "left_semi")
    return kept.unionByName(unpacked(again.groupBy("k_id", "k_key").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")), docs.columns))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents")).drop("n_chunks", "k")


OP3_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept,
       sha256(d.text) AS text_sha256
FROM d JOIN g ON d.text = g.text
"""
