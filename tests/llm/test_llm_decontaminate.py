import random

from helpers import awkward, frame, prose

from tablescope.llm import decontaminate as D


def bench(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")


def shingles(words):
    return [" ".join(words[i:i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [" ".join(words)] if words else []


def similarity(a, b):
    lesser = sum(min(a.count(s), b.count(s)) for s in set(a) & set(b))
    return lesser / (len(a) + len(b) - lesser)


def brute(rows, items):
    """Every window of an item's size at every place."""
    out = {}
    for doc_id, text, *_ in rows:
        words = (text or "").lower().split()
        for item_id, t in items:
            want = (t or "").lower().split()
            best = max((similarity(shingles(words[s:s + len(want)]), shingles(want)) for s in range(max(1, len(words))) if want and words), default=0)
            if best >= 0.8:
                out[doc_id, item_id] = round(best, 6)
    return out


def test_hits_match_all_windows(spark):
    items = [(k, prose(500 + k, 12 + 7 * k)) for k in range(8)] + [(20, "only three words"), (21, ""), (22, None), (23, "a a a a a a a a a a a a")]
    rows, r = [], random.Random(3)
    for k in range(60):
        words = prose(900 + k, 80).split()
        part = items[k % 8][1].split()
        if k % 5 == 1:
            part[len(part) // 2] = "edited"
        if k % 5 == 2:
            part = part[:len(part) // 2]
        if k % 5 == 3:
            part.insert(2, "inserted")
        at = r.randrange(len(words))
        rows.append((k, " ".join(words[:at] + (part if k % 4 else []) + words[at:]).upper()))
    rows += [(70, "say only three words here"), (71, "a a a a a a a a a a a"), (72, items[5][1]), (72, items[5][1]), (73, None), (74, "")]
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in D.decontaminate(frame(spark, rows), bench(spark, items)).collect()}
    assert got == brute(rows, items)
    assert {i for _, i in got} >= {20, 23, 5}


def test_blocks_find_all_fingerprints_within_radius(spark):
    r = random.Random(1)
    base = [r.getrandbits(63) for _ in range(20)]
    near = [(b, b ^ sum(1 << p for p in r.sample(range(63), r.randrange(0, 20)))) for b in base for _ in range(20)]
    df = spark.createDataFrame(near, "a long, b long")
    from pyspark.sql import functions as F
    both = df.distinct().select("a", "b", D.blocks(F.col("a")).alias("x"), D.near_blocks(F.col("b")).alias("y")).collect()
    assert len(both[0]["x"]) == D.BLOCKS
    for r in both:
        probed = {(p["block"], p["value"]) for p in r["y"]}
        assert len(probed) == len(r["y"]) and any((k, v) in probed for k, v in enumerate(r["x"]))


def test_reordered_interleaved_and_shifted_passages(spark):
    items, rows = [], []
    for k in range(30):
        words = prose(600 + k, 60).split()
        items.append((k, " ".join(words)))
        head, tail = prose(3000 + k, 15 + k), prose(5000 + k, 20)
        cut = 10 + k
        swapped = words[cut:] + words[:cut]
        dropped = words[3 + k % 4:]
        inner = words[:cut] + ["odd"] + words[cut:]
        for j, part in enumerate((swapped, dropped, inner, words[cut:] + ["odd", "words"] + words[:cut], words[::-1])):
            rows.append((10 * k + j, f"{head} {' '.join(part)} {tail}"))
        rows.append((10 * k + 6, f"{head} {' '.join(words[:52])}"))  # clipped at the document's end
        rows.append((10 * k + 7, " ".join(words[:30]) + " " + prose(k, 3) + " " + " ".join(words[30:])))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in D.decontaminate(frame(spark, rows), bench(spark, items)).collect()}
    assert got == brute(rows, items)
    assert sum(i % 10 == 0 for i, _ in got) == 30 and sum(i % 10 == 6 for i, _ in got) == 30


def test_clean_awkward_and_empty_tables(spark):
    items = [(1, prose(7777, 30))]
    assert D.decontaminate(frame(spark, awkward()), bench(spark, items)).collect() == []
    assert D.decontaminate(frame(spark, []).limit(0), bench(spark, items)).collect() == []
    assert D.decontaminate(frame(spark, awkward()), bench(spark, items).limit(0)).collect() == []
    docs = frame(spark, awkward() + [(50, "before " + items[0][1] + " after")])
    kept = D.drop_contaminated(docs, bench(spark, items))
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r in awkward())


def test_repetitive_items_are_found_at_any_distance(spark):
    items, rows = [], []
    for k in range(48):
        unit = [f"r{k}x{j}" for j in range(2 + k % 2)]
        size = 14 + k % 3
        items.append((k, " ".join((unit * size)[:size])))
        head = prose(4000 + k, 6) + " "
        rows += [(3 * k, head + " ".join((unit * size)[:size - 1])), (3 * k + 1, head + " ".join((unit * size)[:size - 1]) + " " + prose(k, 5)),
                 (3 * k + 2, head + " ".join((unit * size)[:7]) + " " + prose(k, 9))]
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in D.decontaminate(frame(spark, rows), bench(spark, items)).collect()}
    assert got == brute(rows, items)
    assert len(got) >= 48


def test_items_with_null_and_repeated_ids(spark):
    one, two, three = prose(8001, 20), prose(8002, 25), prose(8003, 30)
    items = [(None, one), (4, two), (4, three)]
    rows = [(1, "x " + one), (2, "y " + two), (3, three + " z"), (4, prose(8004, 40))]
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in D.decontaminate(frame(spark, rows), bench(spark, items)).collect()}
    assert got == {(1, None): 1.0, (2, 4): 1.0, (3, 4): 1.0}
    assert [r["doc_id"] for r in D.drop_contaminated(frame(spark, rows), bench(spark, items)).collect()] == [4]
