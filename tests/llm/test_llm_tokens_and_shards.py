import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import awkward, frame, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from tablescope.llm import byte_bpe as B
from tablescope.llm import sharding as S

CODEC = B.codec(B.TOKENIZER)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks={
    base64.b64decode(a): int(b) for a, b in (x.split() for x in open(public_tokenizers.path(B.TOKENIZER), "rb"))})


def library_ids(text):
    return np.array(LIBRARY.encode_ordinary(text), dtype="<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é'stlver12\n\t .!日😀x  ", max_size=150), st.integers(1, 12))
def test_tree_of_any_leaf_gives_the_library_ids(text, leaf):
    assert CODEC.encode(text, leaf) == library_ids(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200), st.integers(1, 30))
def test_round_trip(text, leaf):
    ids = np.frombuffer(CODEC.encode(text, leaf), "<u4").tolist()
    assert CODEC.decode(ids, leaf) == text.encode()


def test_one_very_long_match():
    for text in ("ab" * 3000, "x" * 5000, "é" * 777 + "zqx" * 300, " " * 999 + "a", "!" * 400 + "'ll"):
        assert CODEC.encode(text, 64) == library_ids(text)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(alphabet="abcdeiorst", min_size=1, max_size=120), st.text(alphabet="ax", max_size=200), st.text(alphabet="é日ü", max_size=60)), st.integers(1, 12))
def test_halves_of_a_match_join_by_windows_of_tokens(word, leaf):
    raw, ranks = word.encode(), CODEC.memo.ranks
    whole = B.merge(raw, ranks)
    assert B.encode_match(raw, ranks, leaf) == whole
    for cut in range(0, len(raw) + 1, 1 + len(raw) // 7):
        left, right = B.merge(raw[:cut], ranks), B.merge(raw[cut:], ranks)
        if left and right:
            assert B.join_tokens(left, right, ranks) == whole


def test_memo_of_two_halves_gives_the_same_ids(monkeypatch):
    monkeypatch.setattr(B, "MEMO_WORDS", 6)
    text = " ".join(prose(k % 5, 40) for k in range(12))
    assert B.Codec(public_tokenizers.path(B.TOKENIZER)).encode(text, 64) == library_ids(text)


def test_op5_digests_on_awkward_rows(spark):
    rows = awkward() + [(90, "<|endoftext|> stays text"), (91, prose(4, 4000))]
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in B.token_digests(frame(spark, rows)).collect())
    want = sorted((str(i), len(library_ids(t or "")) // 4, hashlib.sha256(library_ids(t or "")).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert got == want
    assert B.token_digests(frame(spark, []).limit(0)).collect() == []


def check_shards(rows, got, shards):
    assert len(got) == len(rows)
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    sizes = [0] * shards
    for k in range(shards):
        own = [r for r in got if r["shard"] == k]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        sizes[k] = sum(r["size"] for r in own)
    assert all(r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards for r in got)
    return sizes


def test_shards_of_equal_bytes_with_texts_kept_together(spark):
    r = random.Random(5)
    rows = [(k, prose(k, r.randrange(1, 60))) for k in range(3000)] + [(5000 + k, "a text with a few copies") for k in range(10)]
    got = S.shard_rows(frame(spark, rows)).collect()
    sizes = check_shards(rows, got, 16)
    mean = sum(sizes) / 16
    assert max(abs(s - mean) for s in sizes) < 0.03 * mean
    assert len({x["shard"] for x in got if x["doc_id"] >= 5000}) == 1


def test_a_hot_text_is_split_by_doc_id(spark):
    rows = [(k, "the same text over and over") for k in range(2000)] + [(9000 + k, prose(k, 4)) for k in range(1000)]
    sizes = check_shards(rows, S.shard_rows(frame(spark, rows)).collect(), 16)
    mean = sum(sizes) / 16
    assert max(abs(s - mean) for s in sizes) < 0.02 * mean


def test_shards_of_awkward_few_equal_and_no_rows(spark):
    check_shards(awkward(), S.shard_rows(frame(spark, awkward())).collect(), 16)
    check_shards([(1, "a")], S.shard_rows(frame(spark, [(1, "a")])).collect(), 16)
    check_shards([(1, "a")] * 40, S.shard_rows(frame(spark, [(1, "a")] * 40)).collect(), 16)
    assert S.shard_rows(frame(spark, []).limit(0)).collect() == []


def test_key_order_is_kept_across_shards(spark):
    rows = [(k, prose(k % 50, 10)) for k in range(500)]
    got = sorted(S.shard_rows(frame(spark, rows), shards=4, fine=3).collect(), key=lambda r: (r["shard"], r["slot"]))
    runs = [r["text_crc32"] for r in got]
    assert sum(a != b for a, b in zip(runs, runs[1:])) <= 50 + 11  # equal texts lie together


def test_places_equal_bisect():
    from bisect import bisect_right
    r = random.Random(8)
    for _ in range(30):
        keys = sorted((r.randrange(6), r.randrange(40)) for _ in range(r.randrange(1, 40)))
        rows = [(r.randrange(8), r.randrange(-2, 45)) for _ in range(400)]
        h, d = (np.array(c) for c in zip(*rows))
        assert S._place(h, d, keys).tolist() == [bisect_right(keys, x) for x in rows]


@pytest.mark.parametrize("texts", [20, 37])
def test_many_hot_texts(spark, texts):
    rows = [(k, f"hot text number {k % texts}") for k in range(4000)]
    sizes = check_shards(rows, S.shard_rows(frame(spark, rows)).collect(), 16)
    mean = sum(sizes) / 16
    assert max(abs(s - mean) for s in sizes) < 0.01 * mean + 30


def test_few_probes_a_round_find_the_same_splitters(spark, monkeypatch):
    rows = [(k, prose(k % 90, 6)) for k in range(900)]
    want = sorted((r["doc_id"], r["shard"], r["slot"]) for r in S.shard_rows(frame(spark, rows)).collect())
    monkeypatch.setattr(S, "ALL_PROBES", 1)
    got = S.shard_rows(frame(spark, rows)).collect()
    sizes = check_shards(rows, got, 16)
    assert len(want) == len(got) and max(sizes) < 1.1 * sum(sizes) / 16
