import hashlib

from helpers import awkward, frame, prose
from test_llm_decontaminate import bench, brute as leaks
from test_llm_jaccard import edited, shingles
from test_llm_tokens_and_shards import library_ids

import corpus_pipeline


def test_run_matches_brute_force(spark, tmp_path):
    items = [(k, prose(700 + k, 30)) for k in range(4)]
    rows = awkward() + [(100 + k, prose(k, 80), "en" if k % 2 else "xx") for k in range(60)]
    rows += [(400 + k, prose(k, 80)) for k in range(0, 60, 3)]  # exact copies
    rows += [(600 + k, edited(prose(k, 80), 0.01, k)) for k in range(0, 60, 4)]  # near copies
    rows += [(800 + k, f"{prose(90 + k, 20)} {items[k % 4][1]} {prose(95 + k, 20)}") for k in range(6)]
    frame(spark, rows).write.parquet(f"file://{tmp_path}/documents.parquet")
    bench(spark, items).write.parquet(f"file://{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()

    docs = [(i, t) for i, t, *_ in rows if t is not None and any(c.isalpha() for c in t)]
    best = {}
    for i, t in docs:
        best[t] = max(best.get(t, -1), -1 if i is None else i)
    docs = [(None if i < 0 else i, t) for t, i in best.items()]
    sets, parent = [shingles(t, 5) for _, t in docs], list(range(len(docs)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    groups = {}
    for a in range(len(docs)):
        groups.setdefault(find(a), []).append(docs[a])
    docs = [min(g, key=lambda d: (d[0] is None, d[0])) for g in groups.values()]
    hit = {i for i, _ in leaks([d for d in docs], items)}
    docs = [d for d in docs if d[0] not in hit]
    want = sorted((str(i), len(library_ids(t)) // 4, hashlib.sha256(library_ids(t)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in docs)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want


def test_stages_keep_the_columns(spark, tmp_path):
    docs = frame(spark, awkward())
    bench(spark, [(1, prose(1, 12))]).write.parquet(f"file://{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, f"file://{tmp_path}").columns == docs.columns


def test_empty_tables(spark, tmp_path):
    frame(spark, []).limit(0).write.parquet(f"file://{tmp_path}/documents.parquet")
    bench(spark, [(1, "x")]).limit(0).write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").collect() == []
