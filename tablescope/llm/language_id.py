"""Operator 2, language identification with error-correcting output codes.

Every learned language gets a codeword; one linear classifier over hashed byte 2- and 3-grams
predicts each bit. A text's language is the codeword of least loss: the logistic loss of each
bit's margin, weighted by how reliable that bit is for that language. A text is flagged ambiguous
when the two nearest codewords are about equally near.

Training uses only text and lang, of rows whose crc32(doc_id) mod 5 is not 0, at most about
TRAIN_ROWS of each language (chosen by a hash of doc_id, so alike at any size).

Defined results: ``und`` with score 0 for a null text, a text without a letter, or if nothing
could be learned; with one learned language every other text is that one, with score 1. A row with a
null doc_id counts as held out. Rows with a null lang or no letter teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.llm.common import packed, prepare, read, unpacked

TRAIN_ROWS = 300   # of each language, about
BUCKETS = 4096
BLOCK = 1 << 18    # bytes of a text whose grams are counted at once
EPOCHS = 120
MARGIN = 0.02      # in mean loss: codewords closer than this are ambiguous
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}").search
#: Bytes as features see them: ASCII letters and bytes of other scripts as they are, all else a space.
_PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def features(text: str) -> np.ndarray:
    """The square roots of the shares of hashed 2- and 3-grams, over the whole lower-cased text."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_PLAIN) + b" ", dtype=np.uint8)
    raw = raw[np.concatenate(([True], (raw[1:] != 32) | (raw[:-1] != 32)))]  # a run of spaces is one
    n = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(1, len(raw) - 1), BLOCK):  # blocks share two bytes, so that no gram is lost or counted twice
        part = raw[at:at + BLOCK + 2].astype(np.uint32)
        two = part[:-1] * np.uint32(257) + part[1:]
        three = two[:-1] * np.uint32(263) + part[2:]
        two = two[:BLOCK]
        n += np.bincount(two * np.uint32(2654435761) >> np.uint32(20), minlength=BUCKETS)
        n += np.bincount((three + np.uint32(1 << 25)) * np.uint32(2246822519) >> np.uint32(20), minlength=BUCKETS)
    n = n.astype(np.float32)
    return np.sqrt(n / max(1.0, n.sum()))


def codewords(k: int) -> np.ndarray:
    """``k`` codewords of +1 and -1: all splits for up to five languages, else the best of seeded draws."""
    if k <= 1:
        return np.ones((k, 0))
    if k <= 5:
        splits = [[1 if (s >> i) & 1 else -1 for i in range(k)] for s in range(1 << (k - 1), (1 << k) - 1)]
        return np.array(splits, dtype=float).T
    bits, draw, best, most = max(15, int(np.ceil(10 * np.log2(k)))), np.random.default_rng(7), None, -1
    for _ in range(200):
        c = draw.choice([-1.0, 1.0], size=(k, bits))
        c = c[:, np.abs(c.sum(axis=0)) < k]
        least = min(int((c[i] != c[j]).sum()) for i in range(k) for j in range(i))
        if least > most:
            best, most = c, least
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray     # languages x bits
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray    # languages x bits, rows sum to 1

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, score and ambiguity for each row of features."""
        if len(self.langs) == 1:
            return np.zeros(len(x), int), np.ones(len(x)), np.zeros(len(x), bool)
        margin = x @ self.weights + self.bias
        loss = np.stack([np.logaddexp(0, -margin * c) @ t for c, t in zip(self.code, self.trust)], axis=1)
        order = np.argsort(loss, axis=1, kind="stable")
        near = np.take_along_axis(loss, order[:, :2], axis=1)
        p = np.exp(-(loss - near[:, :1]) * self.code.shape[1])
        return order[:, 0], 1 / p.sum(axis=1), near[:, 1] - near[:, 0] < MARGIN


def fit(x: np.ndarray, y: np.ndarray, langs: list[str]) -> Model:
    """Logistic regression of every bit by full-batch Adam; each language weighs the same."""
    code = codewords(len(langs))
    target = code[y]
    share = 1.0 / np.bincount(y, minlength=len(langs))[y] / len(langs)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for step in range(1, EPOCHS + 1 if code.shape[1] else 1):
        pull = (-target / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30))) * share[:, None]).astype(np.float32)
        for k, (p, g) in enumerate(((w, x.T @ pull + 1e-5 * w), (b, pull.sum(axis=0)))):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    right = (target * (x @ w + b) > 0).astype(float)
    trust = np.stack([(right[y == i].sum(axis=0) + 1) / ((y == i).sum() + 2) for i in range(len(langs))]) if len(langs) else np.ones((0, 0))
    return Model(langs, code, w, b, trust / np.maximum(trust.sum(axis=1, keepdims=True), 1e-9))


def held_out(doc_id: str = "doc_id"):
    crc = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    return (crc % 5 == 0) | F.col(doc_id).isNull()


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """Fit on at most about ``rows`` documents of each language that are not held out."""
    known = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # the label set
    if not counts:
        return None
    rate = F.create_map(*[c for k, n in sorted(counts.items()) for c in (F.lit(k), F.lit(min(1.0, rows / n)))])
    draw = F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = [k for k, t in enumerate(b["text"]) if _LETTER(t)]
            yield pd.DataFrame({"lang": b["lang"].iloc[keep], "doc_id": b["doc_id"].iloc[keep], "x": [features(b["text"].iloc[k]).tobytes() for k in keep]})

    # A vector of fixed size for each of a bounded number of rows.
    got = known.filter(draw < rate[F.col("lang")]).select("doc_id", "lang", "text").mapInPandas(vectors, "lang string, doc_id long, x binary").collect()
    got = sorted(got, key=lambda r: (r["doc_id"], r["lang"], bytes(r["x"])))
    if not got:
        return None
    langs = sorted({r["lang"] for r in got})
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in got])
    return fit(x, np.array([langs.index(r["lang"]) for r in got]), langs)


def predictor(model: Model | None):
    """A Pandas UDF: text -> (lang_pred, score, ambiguous)."""

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            pred, score, unsure = np.array([UNKNOWN] * len(texts), dtype=object), np.zeros(len(texts)), np.ones(len(texts), bool)
            some = [k for k, t in enumerate(texts) if model is not None and t is not None and _LETTER(t)]
            for at in range(0, len(some), 512):
                part = some[at:at + 512]
                best, p, close = model.decode(np.stack([features(texts.iloc[k]) for k in part]))
                pred[part], score[part], unsure[part] = [model.langs[i] for i in best], p, close
            yield pd.DataFrame({"lang_pred": pred, "score": np.clip(score, 0.0, 1.0), "ambiguous": unsure})

    return predict


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous: one row per row of ``docs``."""
    prepare(docs.sparkSession)
    guess = predictor(model or train(docs))(F.col("text").cast("string"))
    return docs.select("doc_id", held_out().alias("held_out"), guess.alias("guess")).select("doc_id", "held_out", "guess.*")


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without texts whose language is unknown (null, or no letter), all columns unchanged."""
    prepare(docs.sparkSession)
    rows = packed(docs).withColumn("guess", predictor(train(docs))(F.col("row.text").cast("string")))
    return unpacked(rows.filter(F.col("guess.lang_pred") != UNKNOWN), docs.columns)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))
