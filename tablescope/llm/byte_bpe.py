"""Operator 5, byte-level BPE encoding and decoding by monoid tree reduction.

A text is halved down to leaves; a leaf is split by the tokenizer's pattern and each match is encoded, so that a node
of the tree is its matches with their ids. Two neighbours are joined by re-encoding a window over their seam: on the left it
starts after the last match whose end lies far enough from the seam that no character beyond it was looked at (the
pattern looks at most two characters past a match and never behind its start); on the right it
grows, doubling, until a match of the window ends where a match of the right half ends and is
itself clear of the window's end. From there on a scan sees the same characters as the right
half's own scan did, so all tokens outside the window are proven unchanged. A window that
finds no such place grows to the whole right half.

A long match is a tree of its own: its halves are encoded and joined by merging a window of tokens again, which
grows on either side until its outer token and the token beyond it encode as just these two. That proves the rest:
merges go by rank, leftmost first, so the first merge that crossed any border between two tokens would do so among
these two alone; a row of tokens of which all neighbours stay apart is the encoding. A match that a seam cuts in two is joined
from its halves' tokens the same way. Decoding concatenates bytes up the same tree.

Defined results: a null text encodes as the empty text, to no ids. Special tokens are never made.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.llm.common import prepare, read, text_of

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
LEAF_CHARS, LEAF_IDS = 1024, 4096
LEAF_BYTES = 64      # of a match that is merged at once
LOOK = 2             # characters past a match's end that the pattern may look at
SEAM_CHARS = 32      # first window over a seam, right of it
SEAM_TOKENS = 2      # first window over a seam inside a match, on either side
NONE = 1 << 30       # above every rank
MEMO_WORDS = 150_000  # distinct matches whose ids a worker remembers: about 40 MB
BATCH_BYTES = 4 << 20


#: What the public pattern matches in ASCII text, for the quicker engine of the standard library. The
#: contractions may come later there, because no other branch before them can start at an apostrophe.
ASCII_PATTERN = r" ?[A-Za-z]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"


class Memo(dict):
    """The ids of a match as little-endian unsigned 32-bit integers. Half of the bound is remembered here and the half
    before it in ``old``: a match that is met again in time moves over, the others go."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks, self.old = ranks, {}
        self.heads = {b: r.to_bytes(4, "little") for b, r in ranks.items()}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            raw = word.encode("utf-8", "surrogatepass")
            ids = self.heads.get(raw)
            if ids is None:
                ids = self.ids_of(encode_match(raw, self.ranks))
        if len(word) <= 64:
            if len(self) >= MEMO_WORDS // 2:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def ids_of(self, tokens: list[bytes]) -> bytes:
        return b"".join(map(self.heads.__getitem__, tokens))


def encode_match(raw: bytes, ranks: dict[bytes, int], leaf: int = LEAF_BYTES) -> list[bytes]:
    """The tokens of one match, a long one by halves."""
    if len(raw) <= leaf:
        return merge(raw, ranks)
    half = len(raw) // 2
    return join_tokens(encode_match(raw[:half], ranks, leaf), encode_match(raw[half:], ranks, leaf), ranks)


def join_tokens(left: list[bytes], right: list[bytes], ranks: dict[bytes, int]) -> list[bytes]:
    """The tokens of the joined bytes from the tokens of two parts."""
    before, after = SEAM_TOKENS, SEAM_TOKENS
    while True:
        start, end = max(0, len(left) - before), min(after, len(right))
        window = merge(b"".join(left[start:] + right[:end]), ranks)
        fits_left = start == 0 or _apart(left[start - 1], window[0], ranks)
        fits_right = end == len(right) or _apart(window[-1], right[end], ranks)
        if fits_left and fits_right:
            return left[:start] + window + right[end:]
        before *= 1 if fits_left else 2
        after *= 1 if fits_right else 2


def _apart(a: bytes, b: bytes, ranks: dict[bytes, int]) -> bool:
    """Whether two tokens side by side encode as these two."""
    return merge(a + b, ranks) == [a, b]


def merge(raw: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Merge neighbours by the lowest rank, leftmost first, until no pair has a rank."""
    if len(raw) > 48:
        return _merge_long(raw, ranks)
    parts = [raw[i:i + 1] for i in range(len(raw))]
    pairs = [ranks.get(raw[i:i + 2], NONE) for i in range(len(raw) - 1)]
    while pairs and (best := min(pairs)) != NONE:
        i = pairs.index(best)
        parts[i] = new = parts[i] + parts.pop(i + 1)
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(new + parts[i + 1], NONE)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + new, NONE)
    return parts


def _merge_long(raw: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The same merges from a heap of pairs over a linked list: n log n for one very long match."""
    n = len(raw)
    parts: list[bytes | None] = [raw[i:i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(raw[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i] if parts[i] is not None else n
        if j >= n or len(parts[i]) + len(parts[j]) != size:
            continue  # one of the two has been merged meanwhile
        parts[i] += parts[j]
        parts[j] = None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a in (before[i], i):
            b = after[a] if a >= 0 else n
            if b < n and (r := ranks.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, len(parts[a]) + len(parts[b])))
    return [p for p in parts if p is not None]


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.memo, self.find_any = Memo(ranks), regex.compile(pattern).findall
        self.find_ascii = re.compile(ASCII_PATTERN, re.ASCII).findall if pattern == public_tokenizers.PATTERN else self.find_any
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            self.bytes_of[r] = b

    def find(self, text: str) -> list[str]:
        return self.find_ascii(text) if text.isascii() else self.find_any(text)

    def node(self, text: str, leaf: int) -> tuple[list[str], list[bytes]]:
        """The matches of the pattern over ``text`` and the ids of each, by halves."""
        if len(text) <= leaf:
            words = self.find(text)
            return words, list(map(self.memo.__getitem__, words))
        half = len(text) // 2
        return self.join(self.node(text[:half], leaf), self.node(text[half:], leaf))

    def join(self, left: tuple[list[str], list[bytes]], right: tuple[list[str], list[bytes]]) -> tuple[list[str], list[bytes]]:
        """The node of the joined text from the nodes of its two parts."""
        (words, ids), (after, after_ids) = left, right
        if not words or not after:
            return left if words else right
        kept, gap = len(words), 0
        while kept and gap < LOOK:  # matches whose end is less than LOOK from the seam
            kept -= 1
            gap += len(words[kept])
        head = "".join(words[kept:])
        want, taken, size = SEAM_CHARS, 0, 0
        ends: dict[int, int] = {}  # an end in the window of a match of the right -> matches up to there
        again: list[str] = []
        done = False
        while not done:
            while taken < len(after) and size < want:
                size += len(after[taken])
                taken += 1
                ends[len(head) + size] = taken
            window = head + "".join(after[:taken])
            again, at = self.find(window), 0
            done = taken == len(after)
            stable = taken
            if not done:
                for k, word in enumerate(again):
                    at += len(word)
                    if at in ends and at + LOOK <= len(window):
                        again, stable, done = again[:k + 1], ends[at], True
                        break
            want *= 2
        long = words[-1] + after[0] if len(words[-1]) + len(after[0]) > LEAF_BYTES else None
        new = [self.joined(ids[-1], after_ids[0]) if word == long else self.memo[word] for word in again]
        return words[:kept] + again + after[stable:], ids[:kept] + new + after_ids[stable:]

    def tokens(self, ids: bytes) -> list[bytes]:
        return list(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def joined(self, left: bytes, right: bytes) -> bytes:
        """The ids of a long match that is two matches of the halves, from their ids."""
        return self.memo.ids_of(join_tokens(self.tokens(left), self.tokens(right), self.memo.ranks))

    def encode(self, text: str, leaf: int = LEAF_CHARS) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(self.node(text, leaf)[1])

    def decode(self, ids: list[int], leaf: int = LEAF_IDS) -> bytes:
        if len(ids) <= leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half], leaf) + self.decode(ids[half:], leaf)


_CODECS: dict[str, Codec] = {}


def codec(name: str) -> Codec:
    """This worker's codec: ``name`` is a tokenizer of public_tokenizers or the path of a rank file."""
    if name not in _CODECS:
        _CODECS[name] = Codec(name if "/" in name else public_tokenizers.path(name))
    return _CODECS[name]


def encode_decode(docs: DataFrame, tokenizer: str = TOKENIZER, leaf: int = LEAF_CHARS) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers), decoded (binary), one row per row."""
    prepare(docs.sparkSession)
    schema = "doc_id long, ids binary, decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for batch in batches:
            ids, texts, out, size = batch.column(0), batch.column(1), ([], [], []), 0
            for k in range(batch.num_rows):
                coded = own.encode(texts[k].as_py(), leaf)
                back = own.decode(np.frombuffer(coded, "<u4").tolist())
                for column, value in zip(out, (ids[k].as_py(), coded, back)):
                    column.append(value)
                size += len(coded) + len(back)
                if size >= BATCH_BYTES or k == batch.num_rows - 1:
                    yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["doc_id", "ids", "decoded"])
                    out, size = ([], [], []), 0

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, schema)


def token_digests(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    return encode_decode(docs, tokenizer).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(read(spark, sf_dir, "documents"))
