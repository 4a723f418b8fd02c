import random
import re
import zlib
from collections import Counter

from helpers import awkward, frame
from hypothesis import given, settings
from hypothesis import strategies as st

from tablescope.llm import spelling as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    others = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, own in others.items():
        best = min(own, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(others[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def got(df):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


def test_equals_brute_force_on_dense_words(spark):
    """Few letters, so that words have many neighbours, repeated letters and chains of forms."""
    r = random.Random(2)
    words = ["".join(r.choice("ab") for _ in range(r.randrange(6, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "baaaaaa", "aaaaaab"]
    words += ["straße", "strasse", "strase", "Élevage", "élevage", "elevage", "ÉLEVAGE", "naïveté", "naïvete"]
    weights = [5 ** r.randrange(4) for _ in words]
    docs = [(k, " ".join(r.choices(words, weights, k=120)) + r.choice(["", ".", "-x", "42abcdef"])) for k in range(120)]
    assert got(S.group_variants(frame(spark, docs))) == brute(docs)


def test_equals_brute_force_on_awkward_rows_and_a_hot_word(spark):
    docs = awkward() + [(100 + k, "common commons comon commonly " * 30 + "rareword") for k in range(40)] + [(None, "common nullid " * 6), (7, "×÷×÷×÷ " * 9)]
    docs += [(300 + k, "x" * 900 + " " + "x" * 899 + " " + "y" + "x" * 899) for k in range(6)]
    assert got(S.group_variants(frame(spark, docs))) == brute(docs)
    assert S.group_variants(frame(spark, []).limit(0)).collect() == []


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text("aàb", min_size=2, max_size=7), min_size=2, max_size=60, unique=True))
def test_near_pairs_are_all_pairs_at_distance_one(spark, words):
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    found = [(r["word"], r["other"]) for r in S.near_pairs(df).collect()]
    assert sorted(found) == sorted((a, b) for a in words for b in words if near(a, b))


def test_candidates_of_words_with_a_common_beginning_stay_few(spark):
    """All words share their first half: candidates are not all pairs."""
    r = random.Random(1)
    words = sorted({"common" + "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(3000)})
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    length = S.F.length("word")
    keys = df.select(S.F.inline(S._keys(S.F.col("word"), length, S.F.lit(0)))).groupBy("key").count()
    assert keys.selectExpr("sum(count * count) AS s").first()["s"] < 12 * len(words)


def test_long_chains_of_forms_reach_their_root(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(37)] + [("a", "w3"), ("b", "c")]
    out = {r["word"]: r["root"] for r in S.roots_of(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert out == {**{f"w{k}": "w37" for k in range(37)}, "a": "w37", "b": "c"}
