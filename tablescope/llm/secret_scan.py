"""Operator 7, secret scans: fixed patterns plus a linear-chain conditional random field.

Base spans come from three fixed patterns. The CRF adds spans of kind ``crf``: every token of every
text is tagged begin, inside or outside from its shape, its neighbours' words and file features, and the
best tagging of the whole text is decoded by Viterbi. Tokens are cut once, over the whole text. Any token
may begin a secret; the only hard constraint is that inside follows begin or inside.

Decoding takes the steps of Viterbi only where they can matter: a secret over tokens i to j changes the score
of all-outside by at most the sum of their gains, so a text in which no sum of gains reaches zero has no secret
(``Tagger.may_hold``, from tables by kind of token, without looking up any token's place), and in the others a token in no
such stretch is outside in every best tagging (``Tagger.tags``). The result is that of Viterbi over all tokens.

The CRF is trained here, by log-likelihood, with the base spans as its labels, on the texts of at
most about TRAIN_DOCS documents (chosen by a hash of doc_id) and at most TRAIN_CHAINS chains of each kind, of at most about
CHAIN tokens: tokens around secrets, around other long tokens (``looks_secret``), and at a place of each text drawn by hash.
Only descriptions of tokens reach the driver, not texts. The base patterns alone would teach the CRF to repeat
them, so chains with a secret are also learnt from with other values and other joints to what stands before them
(``varied``), and with keywords and separators hidden at random; they weigh more where they are few.

Defined results: a null text is empty and has no spans. Positions are code points, end exclusive;
a base span is its pattern's whole match. CRF spans never overlap base spans.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.llm.common import checkpoint, prepare, read, text_of

KINDS = ("assign", "access", "hex", "crf")
# The base patterns and the lengths their matches must reach.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

_HEX_RUN = re.compile(rf"[0-9a-f]{{{LEAST_HEX},}}")  # whole runs of HEX that are long enough
KEYWORDS = ("password", "passwd", "secret", "token", "key", "auth", "credential", "bearer")
HIDDEN = frozenset(["KEY", "=", ":", '"', "'"])
TRAIN_DOCS, TRAIN_CHAINS, EPOCHS, RATE = 20_000, 1500, 4, 0.2
MIN_SECRET, LONG, TOKENS_AROUND, TOKENS_PLAIN, CHAIN = 8, 14, 3, 12, 64  # of training chains
HIDE, POSITIVE_SHARE = 0.5, 0.15  # how often keywords are hidden; the least share of all steps that chains with a secret get
VARIANTS, SWAP_LENGTHS = 8, (12, 49)
JOINTS = ("", "", "=", ":", '="', ':"', '"', "'", "='")
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = (_LOWER + _UPPER + _DIGITS, _LOWER + _UPPER + _DIGITS + "+/", _LOWER + _UPPER + _DIGITS + "-_", _LOWER + _DIGITS, _UPPER + _DIGITS,
             _LOWER + _UPPER, _DIGITS + "abcdef")
KNOWN, KNOWN_CHARS = 1 << 17, 32  # tokens whose kind a task remembers, in each of two halves
TAGS = 3  # outside, begin, inside
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]+|[^\sA-Za-z0-9+/_-]")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted."""
    found = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in _HEX_RUN.finditer(text)]
    return sorted(found)


def tokens_of(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text)]


def looks_secret(token: str) -> bool:
    """Whether training takes the token as a likely mistake: long, and with a digit or an upper-case letter inside, or very long."""
    return len(token) >= MIN_SECRET and (len(token) >= LONG or re.search("[0-9]|.[A-Z]", token) is not None)


def shape(token: str) -> str:
    if not token[0].isalnum() and len(token) == 1:
        return token if token.isascii() else "?"
    kinds = ("d" if re.search("[0-9]", token) else "") + ("u" if re.search("[A-Z]", token) else "") + ("l" if re.search("[a-z]", token) else "") + ("s" if re.search("[+/_-]", token) else "")
    length = min(6, len(token).bit_length())
    mixed = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:]))
    return f"{kinds}{length}m{min(4, mixed)}" + ("x" if re.fullmatch("[0-9a-f]+", token) else "")


def letters(token: str) -> str:
    """How often the case changes, and the longest run of ASCII consonants."""
    turns = len(re.findall("[a-z](?=[A-Z])|[A-Z](?=[a-z])", token))
    run = max(map(len, re.findall("[b-df-hj-np-tv-z]+", token, re.I | re.A)), default=0)
    return f"{min(4, turns)}v{min(6, run)}"


def word_class(token: str) -> str:
    low = token.lower()
    for k in KEYWORDS:
        if k in low:
            return "KEY"
    return low if len(low) == 1 and not low.isalnum() else "num" if low.isdigit() else "word"


def described(text: str, spans: list[tuple[int, int]]) -> list[tuple[str, str, str, bool]]:
    """(shape, letters, word class, whether it touches the token before) of every token."""
    return [(shape(t), letters(t), word_class(t), k > 0 and spans[k - 1][1] == a)
            for k, (a, b) in enumerate(spans) for t in (text[a:b],)]


def names_of(tokens: list[tuple[str, str, str, bool]], file: list[str], hide: bool = False) -> list[list[str]]:
    """The feature names of every described token; ``hide`` shows keywords and what joins them to a value as plain words."""
    classes = [t[2] for t in tokens]
    if hide:
        classes = ["word" if c in HIDDEN else c for c in classes]
    at = lambda i: classes[i] if 0 <= i < len(tokens) else "edge"
    return [[f"s:{form}", f"c:{turns}", f"w:{classes[k]}", f"p:{at(k - 1)}", f"n:{at(k + 1)}", f"pp:{at(k - 2)}|{at(k - 1)}",
             f"sp:{form[:3]}|{at(k - 1)}", "glued" if glued and not hide else "apart", *file] for k, (form, turns, _, glued) in enumerate(tokens)]


def chain_features(text: str, spans: list[tuple[int, int]], file: list[str], hide: bool = False) -> list[list[str]]:
    return names_of(described(text, spans), file, hide)


def file_features(text: str) -> list[str]:
    low = text.lower()
    return [f"f:long{min(5, len(text).bit_length() // 3)}", "f:code" if low.count("=") + low.count("{") > 4 else "f:prose"]


class Crf:
    """Weights by feature and tag, and by tag pair; hard constraints by ``allowed``."""

    def __init__(self) -> None:
        self.w: dict[str, np.ndarray] = {}
        self.t = np.zeros((TAGS, TAGS))
        self.zero = np.zeros(TAGS)

    @staticmethod
    def allowed(token: str, prev: str | None) -> np.ndarray:
        return np.array([0.0, 0.0, -np.inf if prev is None else 0.0])

    #: Inside never follows outside.
    PAIRS = np.array([[0.0, 0.0, -np.inf], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]])

    def scores(self, tokens: list[str], names: list[list[str]]) -> np.ndarray:
        return np.array([sum((self.w.get(n, self.zero) for n in row), self.allowed(t, tokens[k - 1] if k else None))
                         for k, (t, row) in enumerate(zip(tokens, names))])

    def viterbi(self, tokens: list[str], names: list[list[str]]) -> list[int]:
        return self.path(self.scores(tokens, names))

    def path(self, s: np.ndarray, after: bool = False, before: bool = False) -> list[int]:
        """The best tagging of a stretch; ``after`` and ``before``: of one whose neighbour on that side is outside."""
        pair = self.t + self.PAIRS
        best, back = s[0] + pair[0] if after else s[0], []
        for row in s[1:]:
            step = best[:, None] + pair
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + row
        tags = [int((best + pair[:, 0] if before else best).argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]


class Learner:
    """Log-likelihood ascent on arrays: a row of weights for every feature, chains as rows of feature numbers."""

    def __init__(self, names: list[str]) -> None:
        self.names, self.w, self.t = names, np.zeros((len(names), TAGS)), np.zeros((TAGS, TAGS))

    def learn(self, ids: np.ndarray, gold: np.ndarray, rate: float) -> None:
        """One step of size ``rate`` up the log-likelihood of the tags ``gold``, by forward and backward sums."""
        s, n = self.w[ids].sum(axis=1), len(ids)
        s[0, 2] = -np.inf
        s = np.exp(s - s.max(axis=1, keepdims=True))
        pair = np.exp(self.t + Crf.PAIRS)
        a, b = np.empty((n, TAGS)), np.ones((n, TAGS))
        a[0] = s[0] / s[0].sum()
        for k in range(1, n):
            row = (a[k - 1] @ pair) * s[k]
            a[k] = row / row.sum()
        for k in range(n - 2, -1, -1):
            row = pair @ (s[k + 1] * b[k + 1])
            b[k] = row / row.sum()
        at = a * b
        g = -at / at.sum(axis=1, keepdims=True)
        g[np.arange(n), gold] += 1
        np.add.at(self.w, ids, rate * g[:, None, :])
        self.w[ids.ravel()] *= 1 - 0.001 * rate
        if n > 1:
            e = a[:-1, :, None] * pair * (s[1:] * b[1:])[:, None, :]
            e = -(e / e.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            np.add.at(e, (gold[:-1], gold[1:]), 1)
            self.t += rate * e

    def model(self) -> Crf:
        out = Crf()
        out.w, out.t = dict(zip(self.names, self.w)), self.t
        return out


class Tagger:
    """The weights of a model as tables by kind of token and class of neighbour, to score a whole text at once."""

    def __init__(self, model: Crf) -> None:
        self.model, w, zero = model, model.w, model.zero
        parted = {"p": [], "n": [], "pp": [], "sp": []}
        for name in w:
            part, value = name.split(":", 1) if ":" in name else (name, "")
            if part in parted:
                at = 1 if value[0] == "|" else value.find("|")
                parted[part].append((value[:at], value[at + 1:]) if part in ("pp", "sp") else (value,))
        seen = {c for part in ("p", "n", "pp") for row in parted[part] for c in row} | {b for _, b in parted["sp"]}
        self.classes = {c: k for k, c in enumerate(["", "edge", *sorted(seen - {"edge"})])}  # "": any other
        self.starts = {c: k for k, c in enumerate(["", *sorted({a for a, _ in parted["sp"]})])}
        n, at = len(self.classes), self.classes
        self.prev, self.next = np.zeros((n, TAGS)), np.zeros((n, TAGS))
        self.two, self.after = np.zeros((n, n, TAGS)), np.zeros((len(self.starts), n, TAGS))
        for part, table in (("p", self.prev), ("n", self.next)):
            for (c,) in parted[part]:
                table[at[c]] = w[f"{part}:{c}"]
        for a, b in parted["pp"]:
            self.two[at[a], at[b]] = w[f"pp:{a}|{b}"]
        for a, b in parted["sp"]:
            self.after[self.starts[a], at[b]] = w[f"sp:{a}|{b}"]
        self.joint = np.array([w.get("apart", zero), w.get("glued", zero)])
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.kinds: dict[tuple[str, str, str], int] = {}
        self.rows: list[np.ndarray] = []
        self.places: list[tuple[int, int]] = []
        self.own, self.place = np.zeros((0, TAGS)), np.zeros((0, 2), dtype=np.int64)
        # The same tables as gains of begin and inside over outside, for the screening of whole texts.
        over = lambda table: [(table[..., t] - table[..., 0]).ravel() for t in range(1, TAGS)]
        self.cls = self.first = np.zeros(0, dtype=np.int64)
        self.gain: list[np.ndarray] = []
        self.context, self.ahead = over(self.two + self.prev[None, :, :]), over(self.next)
        self.start, self.touch = over(self.after), [g.max() for g in over(self.joint)]
        t = model.t
        self.bounds = t[0, 1] - t[0, 0], t[1:, 0].max() - t[0, 0], t[1:, 1:].max() - t[0, 0]  # enter, leave, stay

    def kind(self, token: str) -> int:
        got = self.known.get(token)
        if got is None and (got := self.older.get(token)) is not None:
            self.remember(token, got)
        if got is None:
            key = shape(token), letters(token), word_class(token)
            got = self.kinds.setdefault(key, len(self.kinds))
            if got == len(self.rows):
                w, zero = self.model.w, self.model.zero
                self.rows.append(w.get(f"s:{key[0]}", zero) + w.get(f"c:{key[1]}", zero) + w.get(f"w:{key[2]}", zero))
                self.places.append((self.classes.get(key[2], 0), self.starts.get(key[0][:3], 0)))
            if len(token) <= KNOWN_CHARS:
                self.remember(token, got)
        return got

    def remember(self, token: str, kind: int) -> None:
        """Tokens not met since the memo was last half full are forgotten."""
        if len(self.known) >= KNOWN:
            self.older, self.known = self.known, {}
        self.known[token] = kind

    def may_hold(self, text: str) -> bool:
        """False if all tokens are provably outside in every best tagging: the sums of gains of ``tags``, with the better
        of touching and not touching the token before, reach zero nowhere. No token's place is looked up for that."""
        tokens = _TOKEN.findall(text)
        kinds = list(map(self.known.get, tokens))
        if None in kinds:
            kinds = [self.kind(t) if k is None else k for t, k in zip(tokens, kinds)]
        if not kinds:
            return False
        if len(self.cls) < len(self.rows):
            own = np.array(self.rows)
            self.gain = [own[:, t] - own[:, 0] for t in range(1, TAGS)]
            self.cls, self.first = np.array(self.places).T.copy()
        k = np.array(kinds)
        around = np.ones(len(k) + 3, dtype=np.int64)
        around[2:-1] = self.cls.take(k)
        one, after = around[1:-2], around[3:]
        two, start = around[:-3] * len(self.classes) + one, self.first.take(k) * len(self.classes) + one
        file = sum(self.model.w.get(f, self.model.zero) for f in file_features(text))
        best = None
        for t in range(TAGS - 1):  # one tag after the other: flat tables are read much faster than rows of two
            g = self.gain[t].take(k) + self.context[t].take(two) + self.ahead[t].take(after) + self.start[t].take(start)
            g += self.touch[t] + file[t + 1] - file[0] + self.bounds[2]
            best = g if best is None else np.maximum(best, g)
        total = np.concatenate([[0.0], best.cumsum()])
        most = (total[1:] - np.minimum.accumulate(total[:-1])).max()
        return bool(most + max(self.bounds[0], 0.0) + max(self.bounds[1], 0.0) - self.bounds[2] >= -1e-3)

    def scores(self, text: str) -> tuple[array, array, np.ndarray]:
        """Starts, ends and scores of all tokens of a text."""
        starts, ends, kinds, kind = array("q"), array("q"), array("q"), self.kind
        for m in _TOKEN.finditer(text):
            a, b = m.span()
            starts.append(a)
            ends.append(b)
            kinds.append(kind(m.group()))
        if not starts:
            return starts, ends, np.zeros((0, TAGS))
        if len(self.own) < len(self.rows):
            self.own, self.place = np.array(self.rows), np.array(self.places)
        k, n = np.frombuffer(kinds, dtype=np.int64), len(starts)
        cls, first = self.place[k].T
        around = np.ones(n + 3, dtype=np.int64)  # the class of text edges is 1
        around[2:-1] = cls
        glued = np.zeros(n, dtype=np.int64)
        glued[1:] = np.frombuffer(starts, dtype=np.int64)[1:] == np.frombuffer(ends, dtype=np.int64)[:-1]
        s = self.own[k] + self.prev[around[1:-2]] + self.next[around[3:]] + self.two[around[:-3], around[1:-2]]
        s += self.after[first, around[1:-2]]
        s += self.joint[glued] + sum(self.model.w.get(f, self.model.zero) for f in file_features(text))
        s[0, 2] = -np.inf
        return starts, ends, s

    def tags(self, s: np.ndarray) -> list[tuple[int, list[int]]]:
        """(place, tags) of the stretches that may hold a secret; all other tokens are outside."""
        n, (enter, leave, stay) = len(s), self.bounds
        total = np.concatenate([[0.0], (s[:, 1:].max(axis=1) - s[:, 0] + stay).cumsum()])
        most = np.maximum.accumulate(total[:0:-1])[::-1] - np.minimum.accumulate(total[:-1])
        live = np.flatnonzero(most + max(enter, 0.0) + max(leave, 0.0) - stay >= -1e-3)
        if not len(live):
            return []
        cut = np.flatnonzero(np.diff(live) > 1)
        bounds = zip(live[np.r_[0, cut + 1]].tolist(), live[np.r_[cut, len(live) - 1]].tolist())
        return [(i, self.model.path(s[i:j + 1], after=i > 0, before=j < n - 1)) for i, j in bounds]


def gold_tags(spans: list[tuple[int, int]], secrets: list[tuple[int, int]]) -> list[int]:
    """Tags by the base spans, sorted."""
    tags, on, lo = [], None, 0
    for a, b in spans:
        while lo < len(secrets) and secrets[lo][1] <= a:
            lo += 1
        at, hit = lo, None
        while at < len(secrets) and secrets[at][0] < b and hit is None:
            hit, at = secrets[at] if a < secrets[at][1] else None, at + 1
        tags.append(0 if hit is None else 2 if hit is on else 1)
        on = hit
    return tags


def training_chains(text: str) -> list[tuple[int, int, list[int], int]]:
    """(first token, end, tags, kind) of the stretches to learn from: 0 with a secret, 1 with a token like one, 2 plain.
    Stretches that meet are one, and parts of at most about CHAIN tokens are cut between secrets (a secret of more than
    4 * CHAIN tokens is cut off there)."""
    spans = tokens_of(text)
    if not spans:
        return []
    tags = gold_tags(spans, sorted(secret_parts(text)))
    near = [(k, TOKENS_AROUND) for k, (a, b) in enumerate(spans) if tags[k] or looks_secret(text[a:b])]
    near.append((zlib.crc32(text.encode("utf-8", "surrogatepass")) % len(spans), TOKENS_PLAIN))
    out: list[list[int]] = []
    for lo, hi in sorted((max(0, k - r), min(len(spans), k + r + 1)) for k, r in near):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    like = lambda lo, hi: any(looks_secret(text[a:b]) for a, b in spans[lo:hi])
    short: list[tuple[int, int]] = []
    for lo, hi in out:  # long stretches in parts, none of which begins inside a secret
        while hi - lo > CHAIN:
            cut = next((k for k in range(lo + CHAIN, min(hi, lo + 4 * CHAIN)) if tags[k] != 2), min(hi, lo + 4 * CHAIN))
            short.append((lo, cut))
            lo = next((k for k in range(cut, hi) if tags[k] != 2), hi)
        if lo < hi:
            short.append((lo, hi))
    return [(lo, hi, tags[lo:hi], 0 if any(tags[lo:hi]) else 1 if like(lo, hi) else 2) for lo, hi in short]


def secret_parts(text: str) -> list[tuple[int, int]]:
    """The secrets themselves (for an assignment its value), to learn from."""
    out = []
    for start, kind, end in base_spans(text):
        m = ASSIGN.match(text, start) if kind == 0 else None
        out.append(m.span(2) if m else (start, end))
    return out


def train(docs: DataFrame, rows: int = TRAIN_DOCS) -> Crf:
    """Fit on the chains of about ``rows`` documents. With nothing to learn from, all is outside."""
    total = docs.count()
    draw = F.pmod(F.xxhash64(F.lit("secrets"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = docs.select("doc_id", text_of().alias("text")).filter(draw < min(1.0, rows / max(total, 1)))

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for text in b["text"]:
                spans, file = tokens_of(text), file_features(text)
                for lo, hi, tags, kind in training_chains(text):
                    left = min(lo, 2)  # neighbours that the features look at
                    near = spans[max(0, lo - left - 1):hi + 1]
                    tokens = described(text, near)[1 if lo - left > 0 else 0:]
                    found.append(([x for t in tokens for x in t[:3]], [t[3] for t in tokens], left, tags, file, kind))
            yield pd.DataFrame(found, columns=["tokens", "glued", "left", "tags", "file", "kind"])

    found = checkpoint(sample.mapInPandas(collect, "tokens array<string>, glued array<boolean>, left int, tags array<int>, file array<string>, kind int"))
    order = F.xxhash64("tokens", "tags", "file")
    got = [r for k in range(3) for r in found.filter(F.col("kind") == k).orderBy(order, "tokens", "tags").limit(TRAIN_CHAINS).collect()]
    hits = sum(r["kind"] == 0 for r in got)
    return fit([(list(zip(r["tokens"][::3], r["tokens"][1::3], r["tokens"][2::3], r["glued"])), r["left"], r["tags"], r["file"]) for r in got], hits) if hits else Crf()


def varied(tokens: list, tags: list[int], draw: np.random.Generator) -> tuple[list, list[int]]:
    """Described tokens and tags with other values in the place of the labelled ones, joined to what stands before them in
    another way: what one corpus's labels look like (40 hexadecimal digits in quotes, say) is not what secrets look
    like elsewhere. A tag of -1 marks a neighbour outside the chain; it stays at its side of it."""
    alphabet, marks = ALPHABETS[draw.integers(len(ALPHABETS))], JOINTS[draw.integers(len(JOINTS))]
    out, kept, quoted = [], [], False
    for token, tag in zip(tokens, tags):
        if tag == 1:
            while out and kept[-1] <= 0 and out[-1][2] in HIDDEN and out[-1][2] != "KEY":
                out.pop()
                kept.pop()
            for mark in marks:
                out.append((mark, letters(mark), mark, bool(draw.random() < 0.5)))
                kept.append(0)
            quoted = marks[-1:] in ('"', "'")
        elif tag <= 0 and kept and kept[-1] > 0 and token[2] in ('"', "'") and not quoted:
            continue  # the closing quote of a value that no longer opens with one
        if tag > 0 and len(token[0]) > 1:  # not a single mark
            value = "".join(alphabet[c] for c in draw.integers(len(alphabet), size=draw.integers(*SWAP_LENGTHS)))
            token = shape(value), letters(value), word_class(value), tag == 2 or bool(marks and draw.random() < 0.7)
        out.append(token)
        kept.append(tag)
    return out, kept


def fit(chains: list[tuple[list, int, list[int], list[str]]], hits: int) -> Crf:
    """A model of ``chains`` (described tokens, how many of them only are neighbours on the left, tags, file features),
    of which the first ``hits`` hold a secret. Chains with a secret count more where they are few, and are learnt from with
    their own values and in VARIANTS other ways (``varied``)."""
    at: dict[str, int] = {}
    number = lambda rows: np.array([[at.setdefault(n, len(at)) for n in row] for row in rows])
    turn, data = np.random.default_rng(11), []
    for k, (tokens, left, tags, file) in enumerate(chains):
        own = [-1] * left + list(tags) + [-1] * (len(tokens) - left - len(tags))
        kinds = []
        for t, tag in [(tokens, own)] + [varied(tokens, own, turn) for _ in range(VARIANTS if k < hits else 0)]:
            inner = [i for i, x in enumerate(tag) if x >= 0]
            rows = [names_of(t, file, hide) for hide in (False, True)]
            kinds.append(([number([r[i] for i in inner]) for r in rows], np.array([tag[i] for i in inner])))
        data.append(kinds)
    learner = Learner(list(at))
    more = max(1.0, min(8.0, POSITIVE_SHARE * (len(chains) - hits) / ((1 - POSITIVE_SHARE) * hits)))
    for epoch in range(EPOCHS):
        for k in turn.permutation(len(data)):
            ids, tags = data[k][turn.integers(len(data[k]))]
            learner.learn(ids[int(turn.random() < HIDE)], tags, RATE / (1 + epoch) * (more if k < hits else 1.0))
    return learner.model()


def crf_spans(text: str, tagger: Tagger, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not tagger.may_hold(text):
        return []
    starts, ends, s = tagger.scores(text)
    out = []
    for at, tags in tagger.tags(s):
        k = 0
        while k < len(tags):
            if tags[k] != 1:
                k += 1
                continue
            end = k + 1
            while end < len(tags) and tags[end] == 2:
                end += 1
            a, b = starts[at + k], ends[at + end - 1]
            if not any(s < b and a < e for s, _, e in base):
                out.append((a, 3, b))
            k = end
    return out


def scan(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """doc_id and spans: array of (kind, start, end) by start, then kind as listed; one row per row."""
    prepare(docs.sparkSession)
    model = model or train(docs)
    span = "struct<kind:string,start:int,end:int>"

    @F.pandas_udf(f"array<{span}>")
    def find(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = Tagger(model)
        for texts in parts:
            found = []
            for text in texts:
                base = base_spans(text)
                both = sorted(base + (crf_spans(text, tagger, base) if model.w else []))
                found.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in both])
            yield pd.Series(found, dtype=object)

    return docs.select("doc_id", find(text_of()).alias("spans"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    base = F.filter("spans", lambda s: s.kind != "crf")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
