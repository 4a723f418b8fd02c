import hashlib
from collections import Counter

import pytest
from helpers import awkward, frame, prose

from tablescope.llm import exact_dedup, line_dedup


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def want_groups(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(text or "", []).append(doc_id)
    return groups


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_dedup_matches_brute_force_with_and_without_collisions(spark, bits):
    rows = awkward() + [(100 + k, prose(k % 7, 300)) for k in range(40)]
    got = exact_dedup.exact_dedup(frame(spark, rows), least=32, most=64, bits=bits).collect()
    groups = want_groups(rows)
    assert len(got) == len(rows)
    by_sha = {sha(t): ids for t, ids in groups.items()}
    kept = Counter()
    for r in got:
        ids = by_sha[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
        assert r["doc_id"] in ids
        if r["kept"]:
            kept[r["text_sha256"]] += 1
            assert r["doc_id"] == r["keep_id"]
    assert kept == Counter({s: 1 for s in by_sha})


def test_recipes_are_content_defined(spark):
    text = " ".join(prose(s, 30) + "." for s in range(60))
    rows = exact_dedup.verified_recipes(frame(spark, [(1, text), (2, "An inserted sentence. " + text)]), least=64, most=512).collect()
    a, b = (set(r["recipe"]) for r in rows)
    assert len(a & b) > 0.8 * len(a)  # cuts find each other again behind the insertion


def test_keep_one_keeps_one_row_of_each_text_and_all_columns(spark):
    docs = frame(spark, awkward())
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r["text"] or "" for r in kept.collect()) == Counter(want_groups(awkward()).keys())


def test_exact_dedup_empty_table(spark):
    docs = frame(spark, []).limit(0)
    assert exact_dedup.exact_dedup(docs).collect() == []
    assert exact_dedup.keep_one(docs).collect() == []


def lines_brute(rows):
    """rows with distinct, non-null ids."""
    seen, out = {}, {}
    for doc_id, text, *_ in sorted(rows, key=lambda r: r[0]):
        lines = None if text is None else text.split("\n")
        gone = set()
        for i in range(len(lines or ()) - 2):
            w = tuple(lines[i:i + 3])
            if not "".join(w).strip():
                continue
            if w in seen:
                gone |= {i, i + 1, i + 2}
            seen[w] = True
        out[doc_id] = (text if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines or ()), len(gone))
    return out


def test_line_dedup_matches_brute_force(spark):
    passage = "\n".join(f"shared line {k}" for k in range(5))
    rows = [(1, None), (2, ""), (3, "\n\n\n\n"), (4, "\n\n\n"), (5, passage), (6, f"top\n{passage}\nend"), (7, f"{passage}\n{passage}"),
            (8, "one\ntwo"), (9, "a\na\na\na\na"), (10, "\n".join(f"line {k % 50}" for k in range(5000))),
            (11, "shared line 1\nshared line 2\nother"), (12, passage.replace("line 4", "line x"))]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.line_dedup(frame(spark, rows)).collect()}
    assert got == lines_brute(rows)


def test_line_dedup_awkward_rows(spark):
    got = line_dedup.line_dedup(frame(spark, awkward())).collect()
    assert len(got) == len(awkward())
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] not in (None, 8, 12)}
    assert by_id[1]["text"] is None and by_id[1]["n_lines"] == 0
    assert by_id[5]["n_removed"] == 0 and by_id[6]["text"] == "" and by_id[6]["n_removed"] == 300
    assert line_dedup.line_dedup(frame(spark, []).limit(0)).collect() == []


def test_repeated_rows_of_one_document_stay_alike(spark):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc\nd")]
    got = sorted((r["doc_id"], r["text"]) for r in line_dedup.line_dedup(frame(spark, rows)).collect())
    assert got == [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "d")]
