"""Operator 9, quality classifier by a weak-label model.

Overlapping heuristic labellers vote good, bad or abstain on every text. Votes are counted by pattern
over the whole corpus (at most 3^labellers patterns); expectation-maximisation on those counts
estimates each labeller's accuracy and the share of good texts, without any given label. Every pattern
then has a posterior, and posteriors are the soft labels of a hashed linear scorer (logistic
regression over hashed words, word shapes and character pairs), fitted on at most about TRAIN_ROWS
documents (chosen by a hash of doc_id, as many good as bad by posterior) and applied to all.

Defined results: a null text is empty; labellers that need words abstain on it, and its length is
voted bad. Rows are scored one by one, so repeated rows get the same result. Nothing is read from the
``labels`` table; tests use it to measure accuracy.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.llm.common import checkpoint, prepare, read, text_of

TRAIN_ROWS = 3000
BUCKETS = 1 << 13
FALSE_BAD = 0.005  # at most this share of a labeller's votes on good texts is bad
EPOCHS, ROUNDS = 150, 200
_KEEP_LETTERS = bytes(b for b in range(256) if b < 128 and not chr(b).isalpha())  # removed to count letters
_MARKS = frozenset(b"!#$%&*+<=>@^_`{|}~\\")


def _vote(value: float, good: float, bad: float) -> int:
    """Good up to ``good``, bad from ``bad`` on, else no vote."""
    return 2 if value <= good else 0 if value >= bad else 1


#: Labellers, in the order of a pattern's digits (0 bad, 1 abstain, 2 good).
LABELLERS = ("marks", "shouting", "stutter", "top_word", "variety", "sentences", "bars", "word_length", "length", "digits", "mark_words")


def votes(text: str) -> list[int]:
    """Every labeller's vote on the whole text."""
    words = text.split()
    n = len(words)
    if not n:
        return [1, 1, 1, 1, 1, 1, 1, 1, 0, 1, 1]
    raw = text.encode("utf-8", "replace")
    size = max(1, len(raw))
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = len(raw) - len(raw.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    marks = sum(raw.count(m) for m in _MARKS) / size
    digits = (len(raw) - len(raw.translate(None, b"0123456789"))) / size
    counts = Counter(words)
    top = counts.most_common(1)[0][1] / n
    same = sum(a == b for a, b in zip(words, words[1:])) / n
    ends = (text.count(". ") + text.count(".\n") + text.rstrip().endswith((".", "!", "?"))) / n
    enough = n >= 12
    return [
        _vote(marks, 0.01, 0.04),
        _vote(upper / max(1, upper + lower), 0.2, 0.5),
        _vote(same, 0.02, 0.15) if enough else 1,
        _vote(top, 0.12, 0.25) if enough else 1,
        (2 if len(counts) / n >= 0.45 else 0 if len(counts) / n <= 0.2 and n < 400 else 1) if enough else 1,
        (2 if 1 / 40 <= ends <= 1 / 3 else 0 if ends < 1 / 200 and n > 40 else 1),
        _vote(counts.get("|", 0) / n, 0.01, 0.1),
        (2 if 3 <= len(text) / n <= 12 else 0 if len(text) / n > 30 else 1),
        (2 if n >= 25 else 0 if n <= 2 else 1),
        _vote(digits, 0.05, 0.3),
        _vote(sum(c * (w[-1] in "!#$%&*+<=>@^_`{|}~") for w, c in counts.items()) / n, 0.02, 0.2),
    ]


def pattern(text: str) -> int:
    code = 0
    for v in votes(text):
        code = code * 3 + v
    return code


def split_pattern(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes // 3 ** (len(LABELLERS) - 1 - k) % 3 for k in range(len(LABELLERS))], axis=1)


@dataclass
class LabelModel:
    """Share of good texts; chance of each vote by class and labeller; posterior by pattern."""

    good: float
    chance: np.ndarray  # 2 x labellers x 3: of a bad, no and good vote, among the votes cast
    posterior: dict[int, float]

    def accuracy(self) -> np.ndarray:
        """For every labeller the chance that its vote is right, if it votes."""
        p = np.array([1 - self.good, self.good])
        right = p[0] * self.chance[0, :, 0] + p[1] * self.chance[1, :, 2]
        cast = (p[:, None] * (self.chance[:, :, 0] + self.chance[:, :, 2])).sum(axis=0)
        return right / np.maximum(cast, 1e-12)


def fit_labels(counts: dict[int, int]) -> LabelModel:
    """Expectation-maximisation from the majority of votes, on the counts of the patterns."""
    codes = np.array(sorted(counts), dtype=np.int64)
    if not len(codes):
        return LabelModel(0.5, np.full((2, len(LABELLERS), 3), 1 / 3), {})
    n = np.array([counts[int(c)] for c in codes], float)
    cast = split_pattern(codes)
    one_hot = np.eye(3)[cast]  # patterns x labellers x 3
    one_hot[:, :, 1] = 0  # an abstention is no evidence: short texts, on which most abstain, are not worse for it
    bad, good = (cast == 0).sum(axis=1), (cast == 2).sum(axis=1)
    q = (good + 0.5) / (good + 3 * bad + 1)  # a single bad vote weighs more: most labellers see one kind of fault
    for _ in range(ROUNDS):
        share = float(np.clip((n * q).sum() / n.sum(), 1e-3, 1 - 1e-3))
        chance = np.stack([np.einsum("i,ijk->jk", n * (1 - q), one_hot), np.einsum("i,ijk->jk", n * q, one_hot)]) + np.array([[[2.0, 0, 1]], [[1.0, 0, 2]]])
        chance = np.maximum(chance / chance.sum(axis=2, keepdims=True), 1e-12)
        # Faults come in kinds that exclude each other; without this bound the two classes would become
        # one kind against all else instead of bad against good.
        chance[1, :, 0] = np.minimum(chance[1, :, 0], FALSE_BAD)
        chance[1, :, 2] = 1 - chance[1, :, 0]
        log = np.einsum("ijk,cjk->ci", one_hot, np.log(chance)) + np.log([[1 - share], [share]])
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - q).max() < 1e-6:
            break
        q = new
    return LabelModel(share, chance, {int(c): float(p) for c, p in zip(codes, q)})


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the whole text: buckets and values, of length one together."""
    out: dict[int, float] = {}
    words = text.split()
    n = max(1, len(words))
    for w, c in Counter(words).items():
        v = c / n
        at = zlib.crc32(w.lower().encode("utf-8", "replace")) % (BUCKETS // 2)
        out[at] = out.get(at, 0.0) + v
        kind = ("U" if w.isupper() and len(w) > 1 else "T" if w[:1].isupper() else "l" if w.islower() else "m") + ("." if not w[-1:].isalnum() else "a") + str(min(4, len(w) // 4)) + w[-1:] * (not w[-1:].isalnum())
        at = BUCKETS // 2 + zlib.crc32(kind.encode("utf-8", "replace")) % (BUCKETS // 4)
        out[at] = out.get(at, 0.0) + v
    for name, value in (("same", sum(a == b for a, b in zip(words, words[1:])) / n), ("distinct", len(set(words)) / n), ("few", 1.0 if n < 5 else 0.0), ("top", max(Counter(words).values(), default=0) / n)):
        at = BUCKETS // 2 + BUCKETS // 4 + zlib.crc32(f"{name}{int(value * 10)}".encode()) % (BUCKETS // 4)
        out[at] = out.get(at, 0.0) + 0.3
    at, v = np.fromiter(out, np.int32, len(out)), np.sqrt(np.fromiter(out.values(), np.float32, len(out)))
    return at, v / max(1e-9, float(np.sqrt((v * v).sum())))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], soft: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by full-batch Adam; both classes weigh the same."""
    at, v = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]).astype(float)
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    weight = soft / max(soft.sum(), 1e-9) + (1 - soft) / max((1 - soft).sum(), 1e-9)
    weight /= weight.sum()
    w, b = np.zeros(BUCKETS), 0.0
    m, s = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for step in range(1, EPOCHS + 1):
        z = np.bincount(row, v * w[at], len(rows)) + b
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - soft)
        grad = np.append(np.bincount(at, v * g[row], BUCKETS) + 1e-6 * w, g.sum())
        m += 0.1 * (grad - m)
        s += 0.01 * (grad * grad - s)
        move = 0.2 * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def classify(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, weak_label (posterior that the text is good), score (of the scorer), quality (0 or 1)."""
    prepare(docs.sparkSession)
    @F.pandas_udf("int")
    def vote(texts: pd.Series) -> pd.Series:
        return texts.map(pattern).astype(np.int32)

    cast = checkpoint(docs.select("doc_id", vote(text_of()).alias("pattern")))
    counts = {r["pattern"]: r["n"] for r in cast.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}  # 3^11 at most
    model = fit_labels(counts)
    score = scorer(docs, model, counts, rows)
    posterior = model.posterior
    w, b = score

    @F.pandas_udf("weak_label double, score double")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            out = []
            for t in texts:
                at, v = features(t)
                z = float(v @ w[at]) + b
                out.append((posterior.get(pattern(t), 0.5), 1 / (1 + np.exp(-np.clip(z, -30, 30)))))
            yield pd.DataFrame(out, columns=["weak_label", "score"])

    return docs.select("doc_id", judge(text_of()).alias("j")).select(
        "doc_id", F.round("j.weak_label", 6).alias("weak_label"), F.round("j.score", 6).alias("score"), (F.col("j.score") >= 0.5).cast("int").alias("quality"))


def scorer(docs: DataFrame, model: LabelModel, counts: dict[int, int], rows: int) -> tuple[np.ndarray, float]:
    """Fit the hashed linear scorer on about ``rows`` documents, half of them good by posterior."""
    good = sum(n for c, n in counts.items() if model.posterior[c] >= 0.5)
    bad = sum(counts.values()) - good
    rate = {True: min(1.0, rows / 2 / max(good, 1)), False: min(1.0, rows / 2 / max(bad, 1))}
    posterior = model.posterior

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, draw, text in zip(b["doc_id"], b["draw"], b["text"]):
                p = posterior.get(pattern(text), 0.5)
                if draw < rate[p >= 0.5]:
                    at, v = features(text)
                    out.append((doc_id, p, at.tobytes(), v.astype(np.float32).tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "p", "at", "v"])

    draw = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = docs.select(F.coalesce("doc_id", F.lit(-1)).cast("long").alias("doc_id"), draw.alias("draw"), text_of().alias("text"))
    some = some.filter(F.col("draw") < max(rate.values()))
    got = some.mapInPandas(vectors, "doc_id long, p double, at binary, v binary").collect()
    got = sorted(got, key=lambda r: (r["doc_id"], bytes(r["at"])))
    if not got:
        return np.zeros(BUCKETS), 0.0
    found = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["v"], np.float32)) for r in got]
    return fit_scorer(found, np.array([r["p"] for r in got]))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"))
