"""Operator 4, line dedup over overlapping three-line windows.

Every run of three consecutive lines is hashed to 128 bits. A window that occurs again in
the corpus is kept at its first occurrence, by (doc_id, line), and covered everywhere else;
the covered positions of a document are merged and its covered lines removed. Windows of white
space only are not compared. A text of fewer than three lines stays as it is.

Defined results: a null text stays null with no lines; the empty text is one empty line. Rows
that repeat a doc_id are first together where that id is first, so full repeats of a row get the
same result. A null doc_id comes after all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.llm.common import BROADCAST_BYTES, checkpoint, let, read

WINDOW = 3
_LAST = (1 << 63) - 1


def _windows(text):
    """An array of (h1, h2) for each window start; null for windows of white space only."""
    return let(F.split(text, "\n"), _hashes)


def _hashes(lines):
    n = F.size(lines) - (WINDOW - 1)

    def one(i):
        at = [F.get(lines, i + k) for k in range(WINDOW)]
        blank = F.trim(F.regexp_replace(F.concat(*at), r"\s+", "")) == ""
        return F.when(~blank, F.struct(F.xxhash64(*at).alias("h1"), F.xxhash64(F.lit("second"), *at).alias("h2")))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one))


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, text (without the covered lines), n_lines, n_removed: one row per row of ``docs``."""
    base = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumns({
        "o": F.coalesce("doc_id", F.lit(_LAST)), "k": F.xxhash64("text")})
    lines = F.split("text", "\n")
    wins = checkpoint(base.select("o", "k", F.posexplode(_windows(F.col("text"))).alias("pos", "w"))
                      .filter("w IS NOT NULL").select("o", "k", "pos", "w.h1", "w.h2"))
    # A third of all rows may share a window: it is counted by partial aggregates, and the joins
    # below deal out both sides afresh, so that AQE can split a hot window.
    again = checkpoint(wins.groupBy("h1", "h2").agg(F.min("o").alias("first"), F.count(F.lit(1)).alias("n"))
                       .filter("n > 1").select("h1", "h2", "first"))
    inside = wins.groupBy("h1", "h2", "o", "k").agg(F.min("pos").alias("at"), F.count(F.lit(1)).alias("n"))
    inside = checkpoint(inside.filter("n > 1").select("h1", "h2", "o", "k", "at"))
    later = wins.join(again, ["h1", "h2"]).filter("o <> first").select("o", "k", "pos")
    within = wins.join(inside, ["h1", "h2", "o", "k"]).filter("pos <> at").select("o", "k", "pos")
    starts = checkpoint(later.unionByName(within).groupBy("o", "k").agg(F.collect_set("pos").alias("starts")))
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (WINDOW - 1)))))
    # Every place counts once in the size; beyond the bound the texts are shuffled to their places.
    places = starts.agg(F.sum(F.size("starts"))).first()[0] or 0
    if places * 64 <= BROADCAST_BYTES:
        starts = F.broadcast(starts)
    rows = base.join(starts, ["o", "k"], "left").withColumns({"lines": lines, "covered": covered})
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("covered"))
    shorter = F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")
    return rows.select(
        "doc_id", F.when(F.col("covered").isNull(), F.col("text")).otherwise(shorter).alias("text"),
        F.greatest(F.coalesce(F.size("lines"), F.lit(0)), F.lit(0)).cast("long").alias("n_lines"),
        F.greatest(F.coalesce(F.size("covered"), F.lit(0)), F.lit(0)).cast("long").alias("n_removed"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read(spark, sf_dir, "documents"))


OP4_SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d WHERE text IS NOT NULL),
w AS (SELECT doc_id, pos, line AS a, lead(line, 1) OVER t AS b, lead(line, 2) OVER t AS c
      FROM l WINDOW t AS (PARTITION BY doc_id ORDER BY pos)),
o AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS nth
      FROM w WHERE c IS NOT NULL AND regexp_matches(a || b || c, '\\S')),
x AS (SELECT DISTINCT doc_id, pos + k AS pos FROM o, (SELECT unnest(range(3)) AS k) WHERE nth > 1),
k AS (SELECT l.doc_id, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE x.pos IS NULL), '') AS text,
             count(x.pos) AS n_removed
      FROM l LEFT JOIN x ON l.doc_id = x.doc_id AND l.pos = x.pos GROUP BY l.doc_id)
SELECT d.doc_id, k.text, CAST(coalesce(len(d.lines), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
