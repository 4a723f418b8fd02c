import random
import re
from collections import Counter

import pytest
from helpers import WORDS, awkward, frame, prose
from pyspark.sql import functions as F

from tablescope.llm import jaccard_join as J

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text, n):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOW)) if x]
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, n, percent):
    """{row index: (set size, component)} by comparing all pairs."""
    sets = [shingles(t, n) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows))


def edited(text, share, seed):
    r = random.Random(seed)
    return " ".join(w if r.random() > share else r.choice(WORDS) + "!" for w in text.split())


def near_copies():
    rows, k = [], 100
    for g in range(6):
        origin = prose(1000 + g, 30 + 40 * g)
        for c in range(25):
            rows.append((k, edited(origin, 0.002 * c, k)))
            k += 1
        for c in range(12):  # chains: each an edit of the one before
            origin = edited(origin, 0.01, k)
            rows.append((k, origin))
            k += 1
    line = prose(5, 12)
    rows += [(2000 + k, line + " " + prose(3000 + k, 5 + k % 9)) for k in range(60)]  # share a line
    return rows


@pytest.mark.parametrize("n,percent,rest", [(4, 85, 4), (4, 85, 0), (5, 80, 0), (5, 80, 10_000)])
def test_components_match_all_pairs(spark, monkeypatch, n, percent, rest):
    monkeypatch.setattr(J, "REST_PAIRS", rest)
    rows = awkward() + near_copies()
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.jaccard_join(frame(spark, rows), n, percent).collect())
    assert got == brute(rows, n, percent)


def test_small_blocks_of_members_and_answers_from_a_pivot(spark, monkeypatch):
    monkeypatch.setattr(J, "REST_PAIRS", 0)
    monkeypatch.setattr(J, "MEMBERS", 3)
    rows = near_copies()
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.jaccard_join(frame(spark, rows)).collect())
    assert got == brute(rows, 4, 85)


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_sets_of_long_blocks_meet_by_parts(spark, monkeypatch, n, percent):
    monkeypatch.setattr(J, "BLOCK", 1)
    monkeypatch.setattr(J, "REST_PAIRS", 10_000)  # no pivots: the parts find every link
    rows = awkward() + near_copies() + mixes(60)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.jaccard_join(frame(spark, rows), n, percent).collect())
    assert got == brute(rows, n, percent)


def mixes(count):
    """Texts of 6 of 40 passages each, in any order, and a few that differ from another in one passage's end."""
    passages, r = [prose(9000 + k, 25) for k in range(40)], random.Random(3)
    rows = [(10_000 + k, " ".join(r.sample(passages, 6))) for k in range(count)]
    return rows + [(20_000 + k, rows[k][1] + " and more") for k in range(0, count, 10)]


@pytest.mark.parametrize("block", [1, J.BLOCK])
def test_texts_mixed_from_few_passages_rarely_meet(spark, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK", block)
    sets, _, classes = J._find_classes(frame(spark, mixes(600)), 4)
    live, entries = J._prefix_lists(sets, classes, 85)
    pairs, size = J._pairs_left(entries)
    met = J._candidates(entries, live, 85).count()
    assert met < pairs / 500 if block == 1 else met < size * block  # a block's pairs: at most half its size for each of its entries


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
@pytest.mark.parametrize("block", [64, 0])
def test_a_text_meets_a_shorter_one_of_the_group_of_sizes_below(spark, monkeypatch, n, percent, block):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "REST_PAIRS", 10_000)  # no pivots: the blocks find every link
    rows, k = [], 0
    for size in range(40, 400, 9):  # a text and its beginning, just linked: all the longer one's rarest shingles are its own
        long = [f"w{k}x{i}" for i in range(size + n - 1)]
        short = -(-size * percent // 100)
        rows += [(k, " ".join(long)), (k + 1, " ".join(long[:short + n - 1]))]
        k += 2
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.jaccard_join(frame(spark, rows), n, percent).collect())
    assert got == brute(rows, n, percent)
    assert all(c == i - i % 2 for i, _, c in got)


def test_texts_that_link_with_nothing_are_cut_into_sets_once(spark, monkeypatch):
    cuts, whole = spark.sparkContext.accumulator(0), J.shingle_set

    def counted(text):
        cuts.add(1)
        return text

    monkeypatch.setattr(J, "shingle_set", lambda text, words: whole(F.udf(counted, "string")(text), words))
    rows = [(k, " ".join(f"w{k}x{i}" for i in range(60))) for k in range(300)]
    rows += [(k + 1000, t + " more") for k, t in rows[:10]]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.jaccard_join(frame(spark, rows)).collect())
    assert got == brute(rows, 4, 85)
    assert len(rows) <= cuts.value <= len(rows) + 40


def test_empty_table_and_table_of_empty_texts(spark):
    assert J.jaccard_join(frame(spark, []).limit(0)).collect() == []
    got = J.jaccard_join(frame(spark, [(1, None), (2, ""), (None, " ")])).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == [("1", 0, "1"), ("2", 0, "2"), ("None", 0, "None")]


def test_keep_one_keeps_a_document_of_each_component(spark):
    docs = frame(spark, near_copies())
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    want = {c for _, _, c in brute(near_copies(), 5, 80)}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 50 + 100)], "a long, b long")
    got = {r["c"]: r["root"] for r in J.components(edges).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 150: 100}


def test_keep_one_with_null_and_repeated_ids(spark):
    a, b, c, d = (prose(7000 + k, 60) for k in range(4))
    rows = [(None, a), (None, a + " more"), (5, b), (5, b + " more"), (6, b), (7, c), (7, c), (8, c), (None, d), (9, d), (1, None), (2, ""), (2, "")]
    kept = sorted((str(r["doc_id"]), r["text"]) for r in J.keep_one(frame(spark, rows)).collect())
    assert [i for i, _ in kept] == ["1", "2", "2", "5", "7", "9", "None"]
    assert set(kept) <= {(str(i), t) for i, t in rows}
