"""Operator 12, the interaction audit of five document filters over all of their orders.

1. One scan gives every document the mask of its row-local failures (A to D), a 64-bit hash of its text and its part.
2. Counting-Bloom prepass. Every text is counted in ``HASHES`` arrays of cells (``CELLS`` cells per row of the table, so
   the sketch keeps its precision at every size). A task's sketch holds only the cells it touched; the tasks'
   sketches merge by adding cells. A text with a cell that was counted once is unique for certain and never moves.
3. Only the texts whose cells were all counted more than once are shuffled, whole, for the least doc_id of each text
   (equal texts combine before the shuffle). That table, by hash, gives the flag E; hashes that two
   different texts share are found in it and decided by the texts themselves.
4. Flags join with the labels into counts by (part, mask), at most 32 masks a part. Counts of masks add up, so every order, step
   and Shapley sum follows from them without another pass over documents.

Defined results: a null text counts as empty (all empty texts are identical), a null source is the part ''. A null
doc_id is neither smaller nor larger than any other: such a row never fails E, nor makes another fail. Rows that repeat
doc_id and text do not fail by each other. A document is labelled good (toxic) if any of its label rows says so, and
repeated label rows count once. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.llm.common import SPACE, checkpoint, if_small, let, read, text_of

FILTERS = "ABCDE"
E_BIT = 1 << FILTERS.index("E")
LEAST_WORDS = 200       # A
MARKS = "[#$%&*|]"      # D
CELLS, HASHES = 16, 2   # a text that is unique passes for a possible repeat with a chance of about (1/CELLS)^HASHES


def local_failures(text: Column) -> Column:
    """The mask of the filters A to D that ``text`` fails (bit k for the k-th letter)."""
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))

    def mask(words: Column) -> Column:
        n, distinct = F.size(words), F.size(F.array_distinct(words))
        failed = [n < LEAST_WORDS, 100 * distinct < 50 * n, 100 * capitals > 2 * F.length(text), text.rlike(MARKS)]
        return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failed)), F.lit(0))

    return let(F.filter(F.split(text, SPACE), lambda w: w != ""), mask)


def _cell(j: int, cells: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(j), F.col("h")), F.lit(cells))


def possible_repeats(rows: DataFrame, cells_per_row: int = CELLS, hashes: int = HASHES) -> DataFrame:
    """(h) of the texts that the merged sketch cannot clear; ``rows`` is a written table with column h."""
    cells = 1 << max(4, (cells_per_row * rows.count() - 1).bit_length())
    counted = rows.select(F.inline(F.array(*[F.struct(F.lit(j).alias("j"), _cell(j, cells).alias("cell")) for j in range(hashes)])))
    crowded = checkpoint(counted.groupBy("j", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("j", "cell"))
    left = rows.select("h")
    for j in range(hashes):
        full = crowded.where(F.col("j") == j).select("cell")
        left = left.join(if_small(full, 24), _cell(j, cells) == F.col("cell"), "left_semi")
    return checkpoint(left.distinct())


def repeats(docs: DataFrame, rows: DataFrame, hashed, **sketch) -> tuple[DataFrame, DataFrame]:
    """((h, first_id) of the texts that occur more than once, (h, text, first_id) where two texts share h)."""
    suspects = docs.select("doc_id", text_of().alias("text")).withColumn("h", hashed(F.col("text")))
    suspects = suspects.join(if_small(possible_repeats(rows, **sketch), 24), "h", "left_semi")
    texts = checkpoint(suspects.groupBy("text").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
                       .withColumn("h", hashed(F.col("text"))))
    shared = checkpoint(texts.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h"))
    repeated = texts.where("n > 1").select("h", "text", "first_id")
    alone = checkpoint(repeated.join(if_small(shared, 24), "h", "left_anti").select("h", "first_id"))
    if shared.isEmpty():
        return alone, None
    return alone, repeated.join(if_small(shared, 24), "h", "left_semi")


def failures(docs: DataFrame, bits: int = 64, **sketch) -> DataFrame:
    """(doc_id, part, mask) for every row of ``docs``. ``bits`` shortens the hash; tests force clashes with it."""
    hashed = lambda t: F.xxhash64(t).bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1))
    text = text_of()
    rows = checkpoint(docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                                  local_failures(text).alias("mask"), hashed(text).alias("h")))
    alone, shared = repeats(docs, rows, hashed, **sketch)
    failed = F.when(F.col("doc_id") > F.col("first_id"), E_BIT).otherwise(0)
    out = rows.join(if_small(alone, 32), "h", "left").select("doc_id", "part", (F.col("mask") + failed).alias("mask"), "h")
    if shared is None:
        return out.drop("h")
    clash = checkpoint(shared.select("h").distinct())
    by_text = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text_of().alias("text")) \
        .withColumns({"h": hashed(F.col("text")), "mask": local_failures(F.col("text"))}).join(if_small(clash, 24), "h", "left_semi")
    by_text = by_text.join(shared, ["h", "text"], "left").select("doc_id", "part", (F.col("mask") + failed).alias("mask"))
    return out.join(if_small(clash, 24), "h", "left_anti").drop("h").unionByName(by_text)


def mask_counts(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): additive counts, at most 32 rows a part."""
    said = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    return (flags.join(said.where("doc_id IS NOT NULL AND (good = 1 OR toxic = 1)"), "doc_id", "left")
            .groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
                                         F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")))


def interactions(counts: DataFrame) -> DataFrame:
    """One row per part, order and step, from ``mask_counts``."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    bit = lambda letter: F.call_function("shiftleft", F.lit(1), F.ascii(letter) - ord(FILTERS[0]))
    before = F.aggregate(F.filter(F.split(F.substring(F.col("filter_order"), F.lit(1), F.col("step") - 1), ""), lambda c: c != ""), F.lit(0),
                         lambda acc, c: acc + bit(c))
    masks = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))  # at most 32 entries
    steps = (masks.select("part", "m", F.explode(F.array(*[F.lit(o) for o in orders])).alias("filter_order"))
             .select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
             .withColumns({"bit": bit(F.substring(F.col("filter_order"), F.col("step"), F.lit(1))), "before": before}))
    has = lambda r, bits: r["mask"].bitwiseAND(bits) != 0

    def total(field, which) -> Column:
        return F.aggregate(F.filter("m", which), F.lit(0).cast("long"), lambda acc, r: acc + field(r))

    n = lambda r: r["n"]
    here = lambda r: has(r, F.col("bit")) & ~has(r, F.col("before"))
    # Of the orders, one in as many as a mask has letters puts this letter first among them.
    share = lambda r: r["n"] * F.floor(F.lit(len(orders)) / F.bit_count(r["mask"]))
    return steps.select(
        "part", "filter_order", "step",
        total(n, lambda r: ~has(r, F.col("before").bitwiseOR(F.col("bit")))).alias("kept"),
        total(n, here).alias("removed"),
        total(n, lambda r: has(r, F.col("bit")) & has(r, F.col("before"))).alias("redundant"),
        total(n, lambda r: r["mask"] == F.col("bit")).alias("unique_fails"),
        total(lambda r: r["good"], here).alias("good_lost"),
        total(lambda r: r["toxic"], here).alias("toxic_lost"),
        total(share, lambda r: has(r, F.col("bit"))).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, bits: int = 64, **sketch) -> DataFrame:
    """The whole audit: one row per part, order of the five filters and step."""
    return interactions(mask_counts(failures(docs, bits, **sketch), labels))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
f AS (SELECT doc_id, part,
        [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
         100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text), regexp_matches(text, '[#$%&*|]'),
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails
      FROM w),
lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
g AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
      FROM f LEFT JOIN lab USING (doc_id) GROUP BY part, fails),
l(x, i) AS (VALUES ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS idx
      FROM l a JOIN l b ON b.i <> a.i JOIN l c ON c.i NOT IN (a.i, b.i) JOIN l d ON d.i NOT IN (a.i, b.i, c.i) JOIN l e ON e.i NOT IN (a.i, b.i, c.i, d.i)),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, idx, idx[step] AS i FROM o CROSS JOIN range(1, 6) t(step)),
r AS (SELECT part, filter_order, step, i, n, good, toxic, fails[i] AS fails_it,
        len(list_filter(idx[1:step - 1], lambda j: fails[j])) > 0 AS gone, len(list_filter(fails, lambda b: b)) AS n_fails FROM g CROSS JOIN s),
t AS (SELECT part, filter_order, step, i,
        sum(CASE WHEN NOT gone AND NOT fails_it THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fails_it THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN gone AND fails_it THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails_it AND n_fails = 1 THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN NOT gone AND fails_it THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND fails_it THEN toxic ELSE 0 END) AS toxic_lost
      FROM r GROUP BY part, filter_order, step, i)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, i) AS BIGINT) AS shapley
FROM t
"""
