"""Values known by hash: the same answers as counting the values themselves, whatever collides or ties."""
import random
from collections import Counter

import pytest

from tablescope.operators import top as TP


def brute(rows):
    out = {}
    for k in {r[0] for r in rows}:
        own = [v for g, v in rows if g == k]
        n = Counter(v for v in own if v is not None)
        best = min(n, key=lambda v: (-n[v], v.encode()), default=None)
        out[k] = (best, n[best] if best is not None else 0, len(n), sum(v is None for v in own))
    return out


def case():
    r = random.Random(4)
    rows = [(1, f"v{r.randrange(40)}") for _ in range(400)]                            # repeated
    rows += [(2, f"unique text number {k} " + "x" * 300) for k in range(300)]             # all tied
    rows += [(3, None)] * 5 + [(4, ""), (4, None), (4, " ")] + [(None, "b"), (None, "a")]   # missing, empty, null key
    rows += [(5, "common front of many texts, " + c) for c in "zyxaé日" for _ in range(3)]  # ties beyond the first bytes
    rows += [(6, "ab"), (6, "ab\x00"), (6, "a")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"bits": 3}, {"broadcast_bytes": 0}, {"broadcast_bytes": 200, "bits": 5}])
def test_most_common_equals_brute_force(spark, options, monkeypatch):
    monkeypatch.setattr(TP, "_FEW", 10)
    rows = case()
    df = spark.createDataFrame(rows, "k int, value string").repartition(5)
    got = {r["k"]: (r["top"], r["top_n"], r["unique_values"], r["missing"]) for r in TP.most_common(df, ["k"], **options).collect()}
    assert got == brute(rows)


def test_no_exchange_of_the_counts_carries_texts(spark):
    df = spark.createDataFrame(case(), "k int, value string")
    plan = TP.count_values(df, ["k"])
    assert dict(plan.dtypes)["_h1"] == "bigint" and plan.where("_text IS NOT NULL").count() == 0
    counted = df.select("k", *TP._hashes(64)).groupBy("k", "_h1", "_h2").count()
    text = counted._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in text.splitlines() if "Exchange" in line]
    assert shuffled and not any("value" in line for line in shuffled)


def test_empty_table(spark):
    df = spark.createDataFrame([], "k int, value string")
    assert TP.most_common(df, ["k"]).collect() == []


def test_tables_of_different_schemas_in_one_exchange(spark):
    from tablescope.operators import profile as P
    a = spark.createDataFrame([(1, "x", None), (2, "x", "p"), (3, "y", "q")], "n int, t string, u string")
    b = spark.createDataFrame([("k",), ("k",), ("j",)], "only string")
    tables = {"a": a, "b": b, "none": spark.range(3), "empty": a.limit(0)}
    got = sorted(tuple(r) for r in P.profile_categorical_tables(tables).collect() if r["dataset"] != "empty")
    want = sorted((t, *r) for t in ("a", "b") for r in P.profile_categorical(tables[t]).collect())
    assert got == want
    empty = [tuple(r)[2:] for r in P.profile_categorical_tables({"empty": tables["empty"]}).orderBy("position").collect()]
    assert empty == [("t", 0, None, 0, 0), ("u", 0, None, 0, 0)]
