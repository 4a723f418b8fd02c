import itertools

import pytest
from helpers import awkward, frame, prose

from tablescope.llm import filter_audit as A

SPACES = " \t\n\x0b\x0c\r"


def words(text):
    for c in SPACES:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, source in docs:
        t = text or ""
        w = words(t)
        fails = {k for k, f in zip("ABCD", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
                                            any(c in "#$%&*|" for c in t))) if f}
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs):
            fails.add("E")
        rows.append((source or "", i, fails))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, x in enumerate(order):
                here = [r for r in left if x in r[2]]
                stay = [r for r in left if x not in r[2]]
                shapley[x] += len(here)
                out[part, "".join(order), k + 1] = [
                    len(stay), len(here), sum(x in r[2] for r in own) - len(here), sum(r[2] == {x} for r in own),
                    sum(r[1] in good for r in here), sum(r[1] in toxic for r in here)]
                left = stay
        for (p, order, k), v in out.items():
            if p == part:
                v.append(shapley[order[k - 1]])
    return {k: tuple(v) for k, v in out.items()}


def result(df):
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"])
            for r in df.collect()}


def case():
    long_words = " ".join(f"w{k}" for k in range(250))
    docs = [(i, t, s) for (i, t), s in zip(awkward(), itertools.cycle(["a", "b", None, ""]))]
    docs += [(100 + k, prose(k % 7, 210), "hot" if k % 3 else "b") for k in range(60)]
    docs += [(200, "x " * 300, "a"), (201, "HELLO THERE " * 120, "a"), (202, long_words, "a"), (203, long_words, "b"), (204, long_words + " 5%", "a"),
             (199, long_words, "c"), (None, long_words, "c"), (205, "a#b", "c")]
    labels = [(k, k % 2, int(k % 3 == 0)) for k in range(0, 210)] + [(202, 1, 1), (202, 0, 0), (None, 1, 1), (9999, 1, 1), (203, None, None)]
    return docs, labels


def tables(spark, docs, labels):
    """With columns that clash with working names."""
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    return (d.selectExpr("*", "1 AS h", "2 AS mask", "'p' AS part", "3 AS first_id", "'en' AS lang").repartition(4),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int").repartition(3))


@pytest.mark.parametrize("options", [{}, {"bits": 3}, {"cells_per_row": 1, "hashes": 1}, {"hashes": 3}])
def test_audit_equals_brute_force(spark, options):
    docs, labels = case()
    assert result(A.audit(*tables(spark, docs, labels), **options)) == brute(docs, labels)


def test_prepass_clears_unique_texts_and_no_repeat(spark):
    docs = [(k, prose(k, 30)) for k in range(3000)] + [(5000 + k, prose(k % 5, 30)) for k in range(900)]
    rows = frame(spark, docs).select(A.F.xxhash64("text").alias("h"))
    passed = {r["h"] for r in A.possible_repeats(rows).collect()}
    repeated = {r["h"] for r in rows.groupBy("h").count().where("count > 1").collect()}
    assert repeated <= passed and len(repeated) == 5
    assert len(passed) < 5 + 0.06 * 3000


def test_empty_tables(spark):
    docs, labels = case()
    d, l = tables(spark, docs, labels)
    assert A.audit(d.limit(0), l).collect() == []
    assert result(A.audit(d, l.limit(0))) == brute(docs, [])
