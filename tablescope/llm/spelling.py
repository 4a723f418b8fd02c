"""Operator 11, spelling variants grouped by asymmetric q-chunks.

Words are the runs of letters of all texts (some of them with one letter deleted, by a fixed hash rule), counted once with a
map-side combine. Two words are near if one inserted, deleted or replaced code point turns one into the other.

Search. Of a pair of near words the longer one (of equal length: the smaller one) is cut into two disjoint chunks. One edit
spoils one chunk at most, so the other chunk stands in the shorter word as a positional gram, moved by the
difference of lengths, zero or one. The spoiled chunk is cut in two again and the same holds: one half of it stands, too.
That leaves four ways, each with a hole of about a quarter of the word that may hold the edit; all else must agree. The
longer word lays its chunks of each way under (length, way, kept chunks); the shorter word lays its grams under the keys of
words of its own length and of one more. One equi-join on these keys gives the candidates; words must agree in
three quarters of their letters at their places to meet, so that a frequent beginning or ending (a third of all words may
share it) does not bring all pairs of such words together. Every candidate is verified by its edit distance, and
counted only in the way whose hole holds the last place where the edit can be, so that a pair counts once.

A word's form is its near word of largest count, if that is at least ``RATIO`` times as frequent; roots follow forms by
pointer doubling (counts grow by ``RATIO`` along a chain, which bounds its length by a logarithm).

Defined results: a null text has no words; a null doc_id counts as the empty text in the hash rule. Repeated rows count
each. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.llm.common import ASCII_LOWER, ASCII_UPPER, checkpoint, read, text_of

RUN = "[a-zÀ-ÿ]+"  # after A-Z became a-z
LEAST_LENGTH, LEAST_COUNT = 6, 5
RATIO = 5
DROP_ONE_IN = 199


def occurrences(docs: DataFrame) -> DataFrame:
    """(word) for every run of letters: lower-cased, and without one letter where the hash rule says so."""
    text = F.translate(text_of(), ASCII_UPPER, ASCII_LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("d", F.lit(":"), "run").cast("binary")))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return runs.select(F.when(F.col("h") % DROP_ONE_IN == 0, less).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    return (occurrences(docs).where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= least_count))


def _cut(text: Column, start, end) -> Column:
    """``text[start:end]`` by code points, with column or number bounds."""
    start, end = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def _holes(length: Column) -> list[tuple[Column, Column]]:
    """The four holes [a, b) of a chunk word: halves of its two chunks. Floors of exact integer divisions."""
    half = F.shiftright(length, 1)
    low, high = F.shiftright(half, 1), half + F.shiftright(length - half, 1)
    return [(F.lit(0), low), (low, half), (half, high), (high, length)]


def _keys(word: Column, length: Column, moved: Column) -> Column:
    """An array of (key, b): what stands on both sides of each hole of a word of ``length``, found in ``word``, in which
    everything behind the hole stands ``moved`` places (0 or -1) from its place."""
    return F.array(*[
        F.struct(F.xxhash64(length, F.lit(way), _cut(word, 0, a), F.lit("|"), _cut(word, b + moved, length + moved)).alias("key"), b.alias("b"))
        for way, (a, b) in enumerate(_holes(length))])


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) for every ordered pair of near words of ``words`` (word, n; words distinct)."""
    length = F.length("word")
    chunks = words.select(F.col("word").alias("w"), F.col("n").alias("wn"), F.inline(_keys(F.col("word"), length, F.lit(0))))
    grams = words.select(F.col("word").alias("v"), F.col("n").alias("vn"), F.inline(F.concat(
        _keys(F.col("word"), length, F.lit(0)), _keys(F.col("word"), length + 1, F.lit(-1))))).drop("b")
    found = chunks.join(grams, "key").where(
        ((F.length("w") > F.length("v")) | ((F.length("w") == F.length("v")) & (F.col("w") < F.col("v"))))
        & (_cut(F.col("w"), 0, F.col("b")) != _cut(F.col("v"), 0, F.col("b")))
        & (F.levenshtein("w", "v", 1) == 1))
    return found.select(F.inline(F.array(
        F.struct(F.col("w").alias("word"), F.col("wn").alias("n"), F.col("v").alias("other"), F.col("vn").alias("other_n")),
        F.struct(F.col("v").alias("word"), F.col("vn").alias("n"), F.col("w").alias("other"), F.col("wn").alias("other_n")))))


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) for every row of ``forms`` (word, form; form not null): where following forms ends."""
    ways = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:  # each round doubles the steps taken
        ahead = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ways = checkpoint(ways.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if ways.where("moved").isEmpty():
            return ways.select("word", "root")


def group_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = checkpoint(vocabulary(docs, least_length, least_count))
    near = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("order"), "other")).alias("best"))
    known = words.join(near, "word", "left")
    fits = -F.col("best.order") >= ratio * F.col("n")
    known = checkpoint(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                    F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.order")).cast("long").alias("form_n")))
    roots = roots_of(known.where("form IS NOT NULL"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), F.col("n").cast("long").alias("n"), "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(read(spark, sf_dir, "documents"))


#: DuckDB has no crc32: the table is built by its rule, and a run's bytes are folded through it. Near words are found by
#: deleting each letter of each word, a way of its own.
OP11_SQL = """
WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
kinds AS (SELECT doc_id, run, count(*) AS k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs GROUP BY doc_id, run),
hashed AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || substr(x, 1 + 2 * i, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS h FROM kinds CROSS JOIN crc),
w AS (SELECT word, sum(k) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, 2 + h % length(run)) ELSE run END AS word, k FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM w, range(1, 40) r(i) WHERE i <= length(word)
  UNION ALL SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) FROM (SELECT word, n, unnest(range(40, length(word) + 1)) AS i FROM w WHERE length(word) >= 40)),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, w.word, w.n FROM less a JOIN w ON a.rest = w.word
  UNION SELECT w.word, a.word, a.n FROM less a JOIN w ON a.rest = w.word),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS top FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * w.n THEN top END AS form_n,
  CASE WHEN top >= 5 * w.n THEN (SELECT min(other) FROM near WHERE near.word = w.word AND near.other_n = top) END AS form FROM w LEFT JOIN best ON w.word = best.word),
walk AS (SELECT word, word AS reached, 0 AS step FROM forms
  UNION ALL SELECT walk.word, forms.form, step + 1 FROM walk JOIN forms ON walk.reached = forms.word WHERE forms.form IS NOT NULL)
SELECT f.word, f.form, r.root, CAST(f.n AS BIGINT) AS n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM forms f JOIN (SELECT word, arg_max(reached, step) AS root FROM walk GROUP BY word) r ON f.word = r.word
"""
