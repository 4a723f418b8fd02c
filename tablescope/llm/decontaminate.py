"""Operator 8, benchmark decontamination by SimHash of item-sized windows (DataFrame functions only).

A window has as many words as a benchmark item. To be similar enough it must hold four fifths of the item's five-word
shingles, in any order (fewer than that many common shingles bound the similarity below 0.8, also of a window clipped at a
document's end), so windows are laid at every start where that many of an item's shingles lie inside, and no other
window matters. Each window and each item gets a 64-bit SimHash of its weighted shingles. Fingerprints are compared by
multi-index Hamming blocks: BLOCKS blocks, of which an item probes all values within RADIUS // BLOCKS bits; two
fingerprints within RADIUS bits differ by no more than that in some block, so every such pair is found.
A fingerprint may lie further off than that at any similarity below 1 (repeated shingles weigh more, and ties give bit 0),
so the pairs of a window and an item whose shingles laid it are candidates at any distance. All candidates are verified
exactly on the shingles' text: similarity is the sum of the lesser weights over the sum of the greater ones, where a
shingle's weight is how often it occurs; a hit needs SIMILARITY or more.

Defined results: null and empty texts and items have no words and no hits; an item of fewer than
five words is one shingle of all its words; a window is clipped to its document. Words are
as in the n-gram join: white space separates, A-Z are lower-cased.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.llm.common import BROADCAST_BYTES, checkpoint, if_small, let, read, text_key, text_of, without, words_of

N, SIMILARITY, RADIUS, BITS = 5, 0.8, 19, 64
BLOCKS = 5  # of 12 or 13 bits, each probed within RADIUS // BLOCKS bits


def _shingles(words: Column, n: int, make) -> Column:
    """``make`` of the words of every shingle, in order; all words as one shingle if they are fewer than ``n``."""
    def of(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: make([F.get(w, i + k) for k in range(n)]))
        return F.when(F.size(w) >= n, many)
    return let(words, of)


def _texts(words: Column, n: int = N) -> Column:
    whole = F.when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))
    return F.coalesce(_shingles(words, n, lambda s: F.concat_ws(" ", *s)), whole)


def fingerprint(shingles: Column) -> Column:
    """64-bit SimHash; a shingle counts as often as it occurs."""
    def of(hashes: Column) -> Column:
        def bit(b: Column) -> Column:
            lean = F.aggregate(hashes, F.lit(0), lambda s, h: s + F.when(F.getbit(h, b) == 1, 1).otherwise(-1))
            return F.when(lean > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(bit(b)))
    return let(F.transform(shingles, lambda s: F.xxhash64(s)), of)


def _cuts() -> list[tuple[int, int]]:
    cut = [i * BITS // BLOCKS for i in range(BLOCKS + 1)]
    return list(zip(cut, cut[1:]))


def blocks(fp: Column) -> Column:
    """The values of the BLOCKS disjoint blocks of a fingerprint."""
    return F.array(*[F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long")) for lo, hi in _cuts()])


def near_blocks(fp: Column, radius: int = RADIUS) -> Column:
    """(block, value) of every value within radius / BLOCKS bits of one of the fingerprint's blocks: of two fingerprints
    within ``radius`` bits, one block of the other is among them."""
    def within(bits: int) -> list[int]:
        return [sum(1 << p for p in places) for n in range(radius // BLOCKS + 1) for places in combinations(range(bits), n)]

    def probed(k: int, lo: int, hi: int) -> Column:
        return F.transform(F.array(*[F.lit(m).cast("long") for m in within(hi - lo)]),
                           lambda m: F.struct(F.lit(k).alias("block"), blocks(fp)[k].bitwiseXOR(m).alias("value")))
    return F.flatten(F.array(*[probed(k, lo, hi) for k, (lo, hi) in enumerate(_cuts())]))


def _similarity(a: Column, b: Column) -> Column:
    """Sum of lesser weights over sum of greater weights."""
    def count(x: Column, s: Column) -> Column:
        return F.size(F.filter(x, lambda y: y == s))
    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, s: n + F.least(count(a, s), count(b, s)))
    return both / (F.size(a) + F.size(b) - both)


def _starts(at: Column, m: Column, similarity: float) -> Column:
    """Starts of all windows that may be similar to an item of ``m`` shingles, of which some fall at the places ``at``
    (sorted): a window, clipped or not, must hold at least the share ``similarity`` of m of them among its m places."""
    need = F.greatest(F.ceil(F.lit(similarity) * m - F.lit(1e-9)).cast("int"), F.lit(1))

    def of(n: Column) -> Column:
        spans = F.transform(F.sequence(F.lit(0), F.size(at) - n), lambda i: F.struct(
            F.greatest(F.get(at, i + n - 1) - m + 1, F.lit(0)).alias("lo"), F.get(at, i).alias("hi")))
        starts = F.transform(F.filter(spans, lambda s: s["lo"] <= s["hi"]), lambda s: F.sequence(s["lo"], s["hi"]))
        return F.when(F.size(at) >= n, F.array_distinct(F.flatten(starts)))
    return let(need, of)


def find_windows(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, k, start, nw, words, named): the windows of ``nw`` words that hold enough of an item's shingles, in whatever
    order, and the keys of those items."""
    sizes = sorted(r["n"] for r in items.select(F.least("nw", F.lit(N)).alias("n")).distinct().collect())  # within 1 to N
    found = None
    base = docs.select("doc_id", text_key().alias("k"), words_of(text_of()).alias("words"))
    for n in sizes:
        hashed = lambda words, n=n: _shingles(words, n, lambda s: F.xxhash64(*s))
        own = items.filter((F.col("nw") == n) if n < N else (F.col("nw") >= N))
        index = checkpoint(own.select("ik", "nw", F.explode(F.array_distinct(hashed(F.col("words")))).alias("h")))
        at = base.select("doc_id", "k", F.posexplode(hashed(F.col("words"))).alias("pos", "h"))
        at = at.join(if_small(index, 32), "h").select("doc_id", "k", "nw", "ik", "pos", F.lit(n).alias("n"))
        found = at if found is None else found.unionByName(at)
    if found is None:
        return base.limit(0).select("doc_id", "k", F.lit(0).alias("start"), F.lit(0).alias("nw"), "words", F.array().cast("array<long>").alias("named"))
    # The places of one item's shingles in one document: at most its words.
    found = found.groupBy("doc_id", "k", "nw", "ik", "n").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    found = found.withColumn("start", F.explode(_starts(F.col("at"), F.col("nw") - F.col("n") + 1, similarity)))
    found = found.groupBy("doc_id", "k", "start", "nw").agg(F.collect_set("ik").alias("named"))
    places = checkpoint(found.groupBy("doc_id", "k").agg(F.collect_list(F.struct("start", "nw", "named")).alias("at")))
    held = places.agg(F.sum(F.aggregate("at", F.lit(0).cast("long"), lambda n, w: n + 40 + 8 * F.size(w["named"])))).first()[0] or 0
    p = places.select(F.col("doc_id").alias("p_id"), F.col("k").alias("p_k"), "at")
    p = F.broadcast(p) if held + 64 * places.count() <= BROADCAST_BYTES else p
    rows = base.join(p, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("k") == F.col("p_k")))
    rows = rows.dropDuplicates(["doc_id", "k"]) if _repeats(docs, places) else rows
    rows = rows.select("doc_id", "k", "words", F.explode("at").alias("w"))
    return rows.select("doc_id", "k", "w.start", "w.nw", F.slice("words", F.col("w.start") + 1, F.col("w.nw")).alias("words"), "w.named")


def _repeats(docs: DataFrame, places: DataFrame) -> bool:
    """Whether rows with windows repeat doc_id and text, so that each would give its windows again."""
    keys = docs.select("doc_id", text_key().alias("k"))
    hit = keys.join(places.select(F.col("doc_id").alias("p_id"), F.col("k").alias("p_k")),
                    F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("k") == F.col("p_k")), "left_semi")
    return not hit.groupBy("doc_id", "k").count().filter("count > 1").isEmpty()


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """One row per document (doc_id, k) and item with a window of that similarity:
    doc_id, k, item_id, start_word, n_words, hamming, similarity (of its best window, the first of equals)."""
    items = benchmark.select("item_id", words_of(text_of()).alias("words")).withColumn("nw", F.size("words")).filter("nw > 0")
    items = items.withColumn("ik", F.monotonically_increasing_id())  # a key of the row, fixed by the checkpoint
    items = items.withColumn("shingles", _texts(F.col("words")))
    items = checkpoint(items.withColumn("fp", fingerprint(F.col("shingles"))))
    wins = find_windows(docs, items, similarity).withColumn("shingles", _texts(F.col("words"))).drop("words")
    wins = checkpoint(wins.withColumn("fp", fingerprint(F.col("shingles"))))
    # A passage that many documents share gives one fingerprint, compared once.
    mine = wins.select("nw", "fp").distinct().select("nw", "fp", F.posexplode(blocks(F.col("fp"))).alias("block", "value"))
    theirs = checkpoint(items.select("nw", F.col("fp").alias("ifp"), "ik", F.inline(near_blocks(F.col("fp"), radius))))
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp")))
    pairs = mine.join(if_small(theirs, 40), ["nw", "block", "value"]).filter(far <= radius)
    near = checkpoint(pairs.select("nw", "fp", "ik").distinct())
    near = near.groupBy("nw", "fp").agg(F.collect_set("ik").alias("near")) if near.count() * 40 > BROADCAST_BYTES else \
        F.broadcast(near.groupBy("nw", "fp").agg(F.collect_set("ik").alias("near")))
    about = items.select("ik", "item_id", F.col("fp").alias("ifp"), F.col("shingles").alias("wanted"))
    either = F.array_union("named", F.coalesce("near", F.array().cast("array<long>")))
    checked = (wins.join(near, ["nw", "fp"], "left").withColumn("ik", F.explode(either)).join(about, "ik")
               .withColumn("hamming", far)
               .withColumn("similarity", _similarity(F.col("shingles"), F.col("wanted")))
               .filter(F.col("similarity") >= similarity))
    first = F.struct(-F.col("similarity"), "start")
    return checked.groupBy("doc_id", "k", "item_id").agg(
        F.min_by(F.struct("start", "nw", "hamming", "similarity"), first).alias("best")).select(
        "doc_id", "k", "item_id", F.col("best.start").alias("start_word"), F.col("best.nw").alias("n_words"),
        F.col("best.hamming").alias("hamming"), F.round("best.similarity", 6).alias("similarity"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item, all columns unchanged."""
    return without(docs, decontaminate(docs, benchmark).select("doc_id", "k"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("k", "hamming")


#: Every window at a place where it meets a shingle of an item, without fingerprints.
OP8_SQL = r"""
WITH words AS (SELECT row_number() OVER () AS d, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
iw AS (SELECT row_number() OVER () AS ik, item_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM benchmark),
i AS (SELECT ik, item_id, len(w) AS nw, least(len(w), 5) AS n, greatest(len(w) - 4, 1) AS m, w FROM iw WHERE len(w) > 0),
wanted AS (SELECT ik, s, count(*) AS weight FROM (SELECT ik, unnest(list_transform(range(m), lambda j: array_to_string(w[j + 1:j + n], ' '))) AS s FROM i) q GROUP BY ik, s),
laid AS (SELECT d, n, pos, array_to_string(w[pos + 1:pos + n], ' ') AS s FROM
    (SELECT d, w, n, unnest(range(len(w) - n + 1)) AS pos FROM words JOIN (SELECT DISTINCT n FROM i) k ON len(w) >= n) q),
hits AS (SELECT laid.d, i.ik, i.m, laid.pos, laid.s, wanted.weight FROM laid JOIN wanted ON laid.s = wanted.s JOIN i ON i.ik = wanted.ik AND i.n = laid.n),
starts AS (SELECT DISTINCT d, ik, m, unnest(range(greatest(pos - m + 1, 0), pos + 1)) AS start FROM hits),
common AS (SELECT x.d, x.ik, x.start, x.m, h.s, least(count(*), h.weight) AS c FROM starts x JOIN hits h ON h.d = x.d AND h.ik = x.ik
    AND h.pos BETWEEN x.start AND x.start + x.m - 1 GROUP BY x.d, x.ik, x.start, x.m, h.s, h.weight),
scored AS (SELECT c.d, c.ik, c.start, sum(c.c) AS both_n, c.m, least(c.m, len(any_value(words.w)) - any_value(i.n) + 1 - c.start) AS have
    FROM common c JOIN words ON words.d = c.d JOIN i ON i.ik = c.ik GROUP BY c.d, c.ik, c.start, c.m),
sim AS (SELECT s.d, i.item_id, i.nw, s.start, CAST(both_n AS DOUBLE) / (s.m + have - both_n) AS similarity FROM scored s JOIN i ON i.ik = s.ik)
SELECT words.doc_id, item_id, CAST(start AS INTEGER) AS start_word, CAST(nw AS INTEGER) AS n_words, round(similarity, 6) AS similarity FROM sim
JOIN words ON words.d = sim.d WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY words.doc_id, words.w, item_id ORDER BY similarity DESC, start) = 1
"""
