"""Operator 6, n-gram Jaccard join by set relations: block-skipped index lists and derived answers.

A document's set is its distinct word shingles, as 64-bit hashes. Documents with one set are one
class, and only classes are joined. Two sets link at 100 * intersection >= percent * union.

1. Sets that can't link are skipped: a linked set shares all but ``slack`` = n - ceil(percent n) of its
   shingles, so a class with more shingles that no other class has is out. A quarter of the hash
   range, written with the sets' keys, is counted first for all documents, the whole range for what is left.
2. Index lists hold each set's prefix: its slack + 1 rarest shingles, of which linked sets share
   one. Shingles that only one set has take up prefix places but no list.
3. Answers: each list's most shared member is its pivot. All members are compared with the pivot only.
   Members linked to it are one component, so pairs among them need no look. A member z that isn't
   linked gets its overlap with every set y linked to the pivot p from the pivot's answer,
   |y n z| = |p n z| - |(p - y) n z| + |(y - p) n z|, from the small differences alone, and only if
   Jaccard's triangle inequality leaves it possible (distance z to p at most twice the threshold).
   Linked members then leave the list, and the rest chooses a new pivot.
4. When that no longer halves the lists' pairs, the rest of each list falls into blocks by size (a block's
   sizes and those of the next are within percent of each other), and an entry skips the block above its own if the
   least size there is more than its place lets a partner have. Entries join within blocks of at most BLOCK of them. The
   sets of longer blocks don't: they join by whole parts of their shingles, rarest first (``_parts``), since
   linked sets differ in fewer shingles than there are parts, so texts mixed from few passages rarely meet.
5. Components: iterated min-label hooking with pointer jumping, written to the checkpoint folder
   each round.

Every link between different sets is found or lies inside a component already found, so the
components are those of all links. Defined results: a null text is empty; an empty set links with
nothing; fewer words than a shingle make the whole sequence one shingle; a null doc_id is no
candidate for a component's smallest doc_id.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.llm.common import BROADCAST_BYTES, checkpoint, if_small, let, packed, read, text_key, text_of, unpacked, without, words_of

WORDS, PERCENT = 4, 85
STAGE_WORDS, STAGE_PERCENT = 5, 80
MEMBERS = 256    # sets whose differences travel together
REST_PAIRS = 4   # pairs for each list entry at which lists are few enough to be joined with themselves
BLOCK = 64       # entries of a list's block that are joined with each other; sets of longer ones join by parts
_LAST = (1 << 63) - 1


def shingle_set(text: Column, words: int) -> Column:
    """The sorted distinct hashes of a text's word shingles."""
    def of(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(words)]))
        whole = F.when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(w) >= words, F.sort_array(F.array_distinct(many))).otherwise(whole)
    return let(words_of(text), of)


def _slack(n: Column, percent: int) -> Column:
    return n - F.floor((n * percent + 99) / 100)


def _linked(inter: Column, a: Column, b: Column, percent: int) -> Column:
    return inter * 100 >= (a + b - inter) * percent


def _overlap(a: str, b: str) -> Column:
    return F.size(F.array_intersect(a, b)).cast("long")


def _lone(tokens: DataFrame, key: str) -> DataFrame:
    """For each class how many of its ``tokens`` no other class has."""
    one = tokens.groupBy("token").agg(F.min(key).alias(key), F.max(key).alias("other")).filter(F.col(key) == F.col("other"))
    return one.groupBy(key).agg(F.count(F.lit(1)).alias("lone"))


class Sets(NamedTuple):
    """The documents' sets, of which only ``keys`` (the key and a quarter of each) is written."""
    docs: DataFrame
    keys: DataFrame
    words: int


def _find_classes(docs: DataFrame, words: int) -> tuple[Sets, DataFrame, DataFrame]:
    """All sets, the keys of every row, and one row for each class."""
    sets = docs.select("doc_id", text_key().alias("k"), shingle_set(text_of(), words).alias("set"))
    quarter = F.filter("set", lambda h: F.shiftrightunsigned(h, 62) == 0)
    keys = checkpoint(sets.select("doc_id", "k", F.size("set").cast("long").alias("n"), F.xxhash64("set").alias("s1"),
                                  F.xxhash64(F.lit("second"), "set").alias("s2"), quarter.alias("quarter")))
    o = F.coalesce("doc_id", F.lit(_LAST))
    classes = keys.filter("n > 0").groupBy("s1", "s2", "n").agg(
        F.min("doc_id").alias("least"), F.min(o).alias("rep"), F.min_by("k", o).alias("rep_k"))
    return Sets(docs, keys, words), keys, checkpoint(classes.withColumn("c", F.monotonically_increasing_id()))


def _prefix_lists(sets: Sets, classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The sets that may link (c, n, set), and their index entries (token, c, n, pos, lone)."""
    tokens = sets.keys.select("s1", F.explode("quarter").alias("token"))
    alive = classes.join(_lone(tokens, "s1"), "s1", "left").filter(F.coalesce("lone", F.lit(0)) <= _slack(F.col("n"), percent))
    alive = checkpoint(alive.select("c", "n", "rep", "rep_k"))
    few = if_small(alive, 64)
    # Texts are cut into sets again after the join, for the few that are left.
    texts = sets.docs.select(F.coalesce("doc_id", F.lit(_LAST)).alias("o"), text_key().alias("k"), text_of().alias("text"))
    some = texts.join(few, (F.col("o") == F.col("rep")) & (F.col("k") == F.col("rep_k"))).select("c", "n", shingle_set(F.col("text"), sets.words).alias("set"))
    some = checkpoint(some.dropDuplicates(["c"]))
    tokens = some.select("c", F.explode("set").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    own = tokens.join(shared, "token").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("own"))
    own = own.join(some.select("c", "n"), "c").withColumn("lone", F.col("n") - F.size("own"))
    own = own.withColumn("own", F.slice("own", F.lit(1), F.greatest(F.lit(0), F.least(F.size("own"), _slack(F.col("n"), percent) + 1 - F.col("lone"))).cast("int")))
    entries = checkpoint(own.select("c", "n", "lone", F.posexplode("own").alias("at", "t")).select(
        F.col("t.token").alias("token"), "c", "n", (F.col("lone") + F.col("at")).alias("pos"), "lone"))
    live = checkpoint(some.join(entries.select("c").distinct(), "c", "left_semi"))
    return live, entries


def _pairs_left(entries: DataFrame) -> tuple[int, int]:
    r = entries.groupBy("token").agg(F.count(F.lit(1)).alias("m")).agg(F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("pairs"), F.sum("m").alias("m")).first()
    return int(r["pairs"] or 0), int(r["m"] or 0)


def _pivot_round(entries: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links found by one round of pivots (a, b), and the entries that are left."""
    pivots = checkpoint(entries.groupBy("token").agg(F.min(F.struct("lone", "c")).alias("p")).select("token", F.col("p.c").alias("p")))
    met = checkpoint(entries.join(pivots, "token").select("token", "c", "n", "pos", "lone", "p"))
    pairs = met.filter("c <> p").select("p", "c").distinct()
    pairs = pairs.join(sets.select("c", F.col("n").alias("nc"), F.col("set").alias("sc")), "c")
    pairs = pairs.join(sets.select(F.col("c").alias("p"), F.col("n").alias("np"), F.col("set").alias("sp")), "p")
    pairs = pairs.withColumn("inter", _overlap("sc", "sp"))
    near = 2 * percent - 100  # by the triangle inequality, for a set linked to a set that links to p
    pairs = pairs.filter(_linked(F.col("inter"), F.col("nc"), F.col("np"), near)).withColumn("linked", _linked(F.col("inter"), F.col("nc"), F.col("np"), percent))
    done = checkpoint(pairs.select("p", "c", "nc", "inter", "linked", F.when(F.col("linked"), F.array_except("sp", "sc")).alias("minus"),
                                   F.when(F.col("linked"), F.array_except("sc", "sp")).alias("plus")))
    links = done.filter("linked").select(F.col("p").alias("a"), F.col("c").alias("b"))
    size = checkpoint(done.filter("linked").groupBy("p").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("blocks")))
    member = F.struct(F.col("nc").alias("n"), "inter", "minus", "plus")
    blocks = (done.filter("linked").join(if_small(size, 32), "p").withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")))
              .groupBy("p", "block").agg(F.collect_list(member).alias("members")).drop("block"))
    z = done.filter("NOT linked").select("p", F.col("c").alias("z"), F.col("nc").alias("nz"), F.col("inter").alias("iz"))
    z = z.join(sets.select(F.col("c").alias("z"), F.col("set").alias("sz")), "z")

    def links_with(m: Column) -> Column:
        most = F.least(F.col("iz"), m.inter) + F.size(m.plus)
        exact = F.col("iz") - F.size(F.array_intersect(m.minus, F.col("sz"))) + F.size(F.array_intersect(m.plus, F.col("sz")))
        return F.when(_linked(most, F.col("nz"), m.n, percent), _linked(exact, F.col("nz"), m.n, percent)).otherwise(F.lit(False))

    blocks = checkpoint(blocks)
    held = blocks.agg(F.sum(F.aggregate("members", F.lit(64).cast("long"), lambda s, m: s + 64 + 8 * (F.size(m.minus) + F.size(m.plus))))).first()[0] or 0
    # Written before the distinct, which would else run in the tasks of the join and keep AQE from splitting a hot pivot.
    met_z = checkpoint(z.join(F.broadcast(blocks) if held <= BROADCAST_BYTES else blocks, "p").filter(F.exists("members", links_with)).select("p", "z"))
    derived = met_z.select(F.col("p").alias("a"), F.col("z").alias("b")).distinct()
    gone = done.filter("linked").select("p", "c")
    left = met.filter("c <> p").join(gone, ["p", "c"], "left_anti").select("token", "c", "n", "pos", "lone")
    return checkpoint(links.unionByName(derived)), checkpoint(left)


def _size_groups(percent: int) -> tuple:
    """The group of a size, and no more than the least and no less than the largest size of a group. Sizes of
    linked sets are in one group or in adjacent ones."""
    width = math.log(100 / percent) * (1 + 1e-9)
    return (lambda n: F.floor(F.log(n) / width), lambda g: F.floor(F.exp(g * width)) - 1, lambda g: F.floor(F.exp((g + 1) * width)) + 1)


def _meet(keyed: DataFrame, key: list[str], extra: Column) -> DataFrame:
    """Pairs (a, b, na, nb) that share a key: both of its group, or one of its group and one of the group below."""
    a = keyed.filter("home").select(*key, F.col("c").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"))
    b = keyed.select(*key, F.col("c").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), "home")
    met = a.join(b, key).filter(((F.col("a") < F.col("b")) | ~F.col("home")) & extra)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
                      F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"),
                      F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb"))


def _blocked(entries: DataFrame, percent: int) -> DataFrame:
    """(token, g, c, n, pos, home): each entry in the blocks of its list that its place lets it reach."""
    group, least, _ = _size_groups(percent)
    reach = F.floor((F.col("n") - F.col("pos")) * (100 + percent) / percent) - F.col("n")  # the largest partner's size
    g = group(F.col("n"))
    both = F.array(F.struct(g.alias("g"), F.lit(True).alias("home")), F.struct((g + 1).alias("g"), F.lit(False).alias("home")))
    laid = entries.select("token", "c", "n", "pos", reach.alias("reach"), F.explode(both).alias("x"))
    # An entry meets the group below in its own block, so its place never lets it skip that.
    return laid.filter(F.col("x.home") | (F.col("reach") >= least(F.col("x.g")))).select("token", "x.g", "c", "n", "pos", "x.home")


def _parts(sets: DataFrame, percent: int) -> DataFrame:
    """(g, part, sig, c, n, pos, home): each set's rarest parts, for its own group of sizes and the one above.

    Sets of group g and below differ in at most ``apart`` shingles if they link. The shingles are dealt into
    1.25 apart + 1 parts by hash, so linked sets agree in all but ``apart`` whole parts, and share one of their apart + 1
    parts that come first in the order: parts with shingles by how many sets hold them, then empty parts."""
    group, _, largest = _size_groups(percent)
    own = group(F.col("n"))
    both = F.array(F.struct(own.alias("g"), F.lit(True).alias("home")), F.struct((own + 1).alias("g"), F.lit(False).alias("home")))
    laid = sets.select("c", "n", "set", F.explode(both).alias("x")).select("c", "n", "set", "x.g", "x.home")
    laid = laid.withColumn("apart", F.floor(2 * largest(F.col("g")) * (100 - percent) / (100 + percent)))
    laid = laid.withColumn("m", F.col("apart") + F.floor(F.col("apart") / 4) + 1)
    whose = ["c", "n", "g", "home", "apart", "m"]
    parts = laid.select(*whose, F.explode("set").alias("h")).groupBy(*whose, F.pmod(F.xxhash64("h"), F.col("m")).alias("part")).agg(F.bit_xor("h").alias("sig"))
    parts = checkpoint(parts)
    shared = parts.groupBy("g", "part", "sig").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    real = F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "part", "sig"))).alias("real")
    rows = parts.join(shared, ["g", "part", "sig"], "left").groupBy(*whose).agg(real)
    first = F.filter(F.slice("real", F.lit(1), (F.col("apart") + 1).cast("int")), lambda r: r.df > 1)
    empty = F.array_except(F.sequence(F.lit(0).cast("long"), F.col("m") - 1), F.transform("real", lambda r: r.part))
    empty = F.slice(empty, F.lit(1), F.greatest(F.lit(0), F.col("apart") + 1 - F.size("real")).cast("int"))
    picked = F.concat(F.transform(first, lambda r: F.struct(r.part.alias("part"), r.sig.alias("sig"))),
                      F.transform(empty, lambda e: F.struct(e.alias("part"), F.lit(0).cast("long").alias("sig"))))
    return rows.select("c", "n", "g", "home", F.explode(picked).alias("k")).select(
        "g", "k.part", "k.sig", "c", "n", F.lit(0).cast("long").alias("pos"), "home")


def _candidates(entries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) of which every link between sets that share a list is one."""
    lengths = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    most = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))  # shared at their first common shingle, at best
    blocked = checkpoint(_blocked(entries, percent))
    long = checkpoint(blocked.groupBy("token", "g").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > BLOCK).select("token", "g"))
    # Entries of a pair behind its first common one may be skipped here too; the first one never is.
    pairs = _meet(blocked.join(if_small(long, 32), ["token", "g"], "left_anti"), ["token", "g"], lengths & _linked(most, F.col("na"), F.col("nb"), percent))
    hot = checkpoint(blocked.join(if_small(long, 32), ["token", "g"], "left_semi").select("c").distinct())
    if not hot.isEmpty():
        parts = checkpoint(_parts(sets.join(if_small(hot, 16), "c", "left_semi"), percent))
        pairs = pairs.unionByName(_meet(parts, ["g", "part", "sig"], lengths))
    return checkpoint(pairs.distinct())


def _rest(entries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among what is left in each list."""
    pairs = _candidates(entries, sets, percent)
    pairs = pairs.join(sets.select(F.col("c").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("c").alias("b"), F.col("set").alias("sb")), "b")
    return checkpoint(pairs.filter(_linked(_overlap("sa", "sb"), F.col("na"), F.col("nb"), percent)).select("a", "b"))


def links(sets: DataFrame, entries: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes whose components are those of all links."""
    found = None
    pairs, m = _pairs_left(entries)
    while pairs > REST_PAIRS * m:
        more, entries = _pivot_round(entries, sets, percent)
        found = more if found is None else found.unionByName(more)
        before, (pairs, m) = pairs, _pairs_left(entries)
        if pairs * 2 > before:
            break
    rest = _rest(entries, sets, percent)
    return rest if found is None else found.unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """(c, root): the smallest class of every class's component, for classes with an edge."""
    both = checkpoint(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = checkpoint(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("root")))
    while True:
        # A class takes the least root among its neighbours, and the root itself hooks onto it too. A root may hold a
        # third of all classes: what is joined by root is a written table, so that AQE can split it.
        near = label.select(F.col("c").alias("b"), "root")
        seen = checkpoint(both.join(if_small(near, 32), "b").groupBy("a").agg(F.min("root").alias("low")))
        own = checkpoint(label.join(seen, label.c == seen.a).select("c", "root", F.least("root", "low").alias("low")))
        hook = checkpoint(own.filter("low < root").groupBy(F.col("root").alias("r")).agg(F.min("low").alias("hook")))
        own = own.join(if_small(hook, 32), F.col("root") == F.col("r"), "left")
        own = checkpoint(own.select("c", "root", F.least("low", F.coalesce("hook", "low")).alias("new")))
        jump = own.select(F.col("c").alias("j"), F.col("new").alias("further"))
        new = own.join(if_small(jump, 32), F.col("new") == F.col("j"), "left")
        new = checkpoint(new.select("c", F.col("root").alias("old"), F.least("new", F.coalesce("further", "new")).alias("root")))
        label = new.select("c", "root")
        if new.filter("root <> old").isEmpty():
            return label


def _rows(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, k, n_shingles, component_id, root: one row per row of ``docs``; root is the component's own key, null for an empty set."""
    sets, keys, classes = _find_classes(docs, words)
    live, entries = _prefix_lists(sets, classes, percent)
    label = components(links(live, entries, percent))
    groups = classes.join(label, "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = checkpoint(groups.filter(F.col("c").isNotNull()).groupBy("root").agg(F.min("least").alias("component_id")))
    named = checkpoint(groups.join(least, "root").select("s1", "s2", "n", "component_id", "root"))
    return keys.join(named, ["s1", "s2", "n"], "left").select(
        "doc_id", "k", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "root")


def jaccard_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, k, n_shingles, component_id: one row per row of ``docs``."""
    return _rows(docs, words, percent).drop("root")


def keep_one(docs: DataFrame, words: int = STAGE_WORDS, percent: int = STAGE_PERCENT) -> DataFrame:
    """``docs`` with one row of each component, all columns unchanged: the smallest doc_id (null last), of its texts
    the smallest text_key, of rows equal in both the one whose columns hash lowest. Empty sets stay."""
    found = checkpoint(_rows(docs, words, percent).filter(F.col("root").isNotNull()).select("doc_id", "k", "root"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")).alias("first")
    best = checkpoint(found.groupBy("root").agg(first, F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("root", "first.doc_id", "first.k")
                      .withColumnsRenamed({"doc_id": "f_id", "k": "f_k"}))
    judged = checkpoint(found.join(if_small(best, 64), "root").select(
        "doc_id", "k", (F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("k") == F.col("f_k"))).alias("stays")))
    kept = without(docs, judged.filter("not stays").select("doc_id", "k"))
    again = checkpoint(judged.filter("stays").groupBy("doc_id", "k").count().filter("count > 1").select(
        F.col("doc_id").alias("g_id"), F.col("k").alias("g_key")))
    if again.isEmpty():
        return kept
    rows = packed(kept).withColumns({"k_id": F.col("row.doc_id"), "k_key": text_key("row.text")})
    same = F.col("k_id").eqNullSafe(F.col("g_id")) & (F.col("k_key") == F.col("g_key"))
    one = rows.join(if_small(again, 64), same, "left_semi").groupBy("k_id", "k_key").agg(
        F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    rest = rows.join(if_small(again, 64), same, "left_anti")
    return unpacked(rest.select("row").unionByName(one.select("row")), docs.columns)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read(spark, sf_dir, "documents")).drop("k")


#: All pairs of texts by their common shingles, and the closure of their links.
OP6_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
t AS MATERIALIZED (SELECT row_number() OVER () AS c, w, sh, len(sh) AS n FROM (SELECT w, list_distinct(
    CASE WHEN len(w) >= 4 THEN list_transform(range(len(w) - 3), lambda j: array_to_string(w[j + 1:j + 4], ' '))
         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM (SELECT DISTINCT w FROM d) e) f),
x AS MATERIALIZED (SELECT c, n, unnest(sh) AS h FROM t),
links AS MATERIALIZED (SELECT a.c AS a, b.c AS b FROM x a JOIN x b ON a.h = b.h AND a.c < b.c GROUP BY a.c, b.c, a.n, b.n
    HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edges AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT c, c AS r FROM t UNION SELECT reach.c, edges.b FROM reach JOIN edges ON reach.r = edges.a),
least AS (SELECT reach.c, min(d.doc_id) AS m FROM reach JOIN t ON t.c = reach.r JOIN d ON d.w = t.w GROUP BY reach.c)
SELECT d.doc_id, CAST(t.n AS BIGINT) AS n_shingles, CASE WHEN t.n = 0 THEN d.doc_id ELSE least.m END AS component_id
FROM d JOIN t ON t.w = d.w JOIN least ON least.c = t.c
"""
