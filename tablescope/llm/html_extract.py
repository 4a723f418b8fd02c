"""Operator 1, HTML main text by gradient-boosted trees over DOM nodes, decoded by hierarchy.

A page becomes a tree of block elements (and inline ones that carry attribute tokens). Every node is
described by its subtree's density (text, links, tags, sentences), attribute tokens, tag, depth and
siblings; boosted trees give the probability that it holds main text. Decoding picks the most
likely labelling in which a kept node's ancestors are all kept and a dropped node's descendants
are all dropped, by one pass up and one pass down the tree.

The trees are trained here on at most about TRAIN_PAGES pages (chosen by a hash of page_id): pages
that mark their article or main element supply the labels. Each training page counts twice,
once with the names of tags and attributes hidden, so that density, links and place decide too.

Defined results: a null or empty page gives the empty text. Character references are decoded, white space
(Unicode) inside a block becomes one space, blocks are joined by one newline; a line break element is
white space. Without a page to learn from, nodes are judged by tags and attribute tokens alone.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.llm.common import prepare, read

TRAIN_PAGES, TRAIN_NODES = 400, 200  # pages, and nodes of a page, to learn from
TREES, DEPTH, RATE, BINS = 40, 3, 0.2, 32

# HTML's element groups.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe textarea title".split())
INLINE = frozenset("""a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img
object canvas audio video math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder mspace mstyle semantics""".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table td th body html div section article main aside nav header footer form".split())
CHROME = frozenset("nav footer header aside form menu button dialog fieldset figcaption select".split())
BODY = frozenset("article main".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: Attribute tokens (class, id, role) that usually name something beside the main text.
BESIDE = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner nav navbar
navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer foot colophon copyright sidebar side aside widget
widgets related recommended recommendations more trending popular share sharing social follow comment comments
commentlist reply replies respond disqus discussion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe
subscription signup login search form tags tagcloud pagination pager toolbar skip hidden complementary contentinfo
contact feedback rating reviews toc outbrain taboola""".split())
#: Attribute tokens that usually name the main text.
WITHIN = frozenset("article main content post entry body text story maincontent hentry blog page".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")


@dataclass
class Page:
    """Nodes in page order (parents first) and pieces of text: (block, node, text, inside a link)."""

    tag: list[str] = field(default_factory=list)
    tokens: list[frozenset[str]] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    pieces: list[tuple[int, int, str, bool]] = field(default_factory=list)


def parse(source: str) -> Page:
    page = Page(["html"], [frozenset()], [-1])
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements, with the node their text belongs to
    block, at, links = 0, 0, 0
    seen_low = source.lower() if len(source.lower()) == len(source) else source

    def pop_to(depth: int) -> None:
        nonlocal block, links
        while len(stack) > depth:
            name, _ = stack.pop()
            block += name not in INLINE
            links -= name == "a"

    def text(upto: int) -> None:
        if upto > at and len(raw := source[at:upto]):
            page.pieces.append((block, stack[-1][1], html.unescape(raw), links > 0))

    while m := _TAG.search(source, at):
        text(m.start())
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name), None)
            if depth is not None:
                pop_to(depth)
            continue
        if name in RAW:
            if not m[3].endswith("/"):
                end = seen_low.find(f"</{name}", at)
                at = len(source) if end < 0 else (source.find(">", end) + 1 or len(source))
            continue
        if name == "svg":  # a drawing; one that is not closed hides nothing
            end = -1 if m[3].endswith("/") else seen_low.find("</svg", at)
            at = at if end < 0 else (source.find(">", end) + 1 or len(source))
            continue
        if name in CLOSES_P or name in ("input", "select"):  # nothing but options stands in a list of choices
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == "select"), None)
            if depth is not None:
                pop_to(depth)
        if name == "html":
            continue
        if name == "br":
            page.pieces.append((block, stack[-1][1], " ", False))
        if name in CLOSES_P:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == "p" or stack[k][0] in SCOPES), None)
            if depth is not None and stack[depth][0] == "p":
                pop_to(depth)
        elif name in SELF_CLOSING:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in SELF_CLOSING[name]:
                    pop_to(k)
                    if name != "tr":
                        break
                elif stack[k][0] in SCOPES:
                    break
        block += name not in INLINE
        if name in VOID:
            continue
        found = {w.lower() for a in _ATTR.finditer(m[3]) for w in _WORD.findall(a[2] or a[3] or a[4] or "")}
        found |= {v.lower() for a in _ATTR.finditer(m[3]) for v in (a[2] or a[3] or a[4] or "").split()}
        node = stack[-1][1]
        if name not in INLINE or found:
            page.tag.append(name)
            page.tokens.append(frozenset(found))
            page.parent.append(node)
            node = len(page.tag) - 1
        if not m[3].endswith("/") or name not in INLINE:
            stack.append((name, node))
            links += name == "a"
    text(len(source))
    return page


FEATURES = ("chars", "share", "link_share", "tags_per_char", "nodes", "depth", "sibling", "siblings", "prose_share", "stops_per_char", "commas_per_char",
            "mean_piece", "own_chars", "beside", "within", "beside_above", "within_above", "chrome", "chrome_above", "body", "body_above", "prose", "item", "place")
NAMED = [FEATURES.index(n) for n in FEATURES[13:23]]  # those that tags and attributes name


def describe(page: Page) -> np.ndarray:
    """A row of FEATURES for every node."""
    n = len(page.tag)
    parent = np.array(page.parent)
    own, link, prose, stops, commas, pieces, tags = (np.zeros(n) for _ in range(7))
    first = np.full(n, -1.0)
    seen = 0
    for _, node, text, inside in page.pieces:
        size = len(text.strip())
        if not size:
            continue
        own[node] += size
        pieces[node] += 1
        link[node] += size * inside
        prose[node] += size * (page.tag[node] in PROSE)
        stops[node] += text.count(". ") + text.rstrip().endswith(".")
        commas[node] += text.count(",")
        if first[node] < 0:
            first[node] = seen
        seen += size
    tags += 1
    total = [own.copy(), link, prose, stops, commas, pieces, tags]
    children, index = np.zeros(n), np.zeros(n)
    for k in range(n - 1, 0, -1):
        p = parent[k]
        for t in total:
            t[p] += t[k]
        if first[k] >= 0 and (first[p] < 0 or first[k] < first[p]):
            first[p] = first[k]
    depth, flags = np.zeros(n), np.zeros((n, 10))
    for k in range(n):
        name, tok, p = page.tag[k], page.tokens[k], parent[k]
        beside, within, chrome, body = bool(tok & BESIDE), bool(tok & WITHIN), name in CHROME, name in BODY
        above = flags[p] if k else np.zeros(10)
        if k:
            depth[k] = depth[p] + 1
            index[k] = children[p]
            children[p] += 1
        flags[k] = (beside, within, above[0] or above[2], above[1] or above[3], chrome, above[4] or above[5], body, above[6] or above[7], name in PROSE, name in ("li", "td", "th", "dt", "dd"))
    chars, link, prose, stops, commas, pieces, tags = total
    size = np.maximum(chars, 1)
    siblings = np.where(parent >= 0, children[parent], 1)
    return np.column_stack([np.log1p(chars), chars / max(chars[0], 1), link / size, tags / size, np.log1p(tags), depth, index, siblings, prose / size,
                            stops / size, commas / size, chars / np.maximum(pieces, 1), np.log1p(own), flags, np.maximum(first, 0) / max(chars[0], 1)]).astype(np.float32)


def marked(page: Page) -> np.ndarray | None:
    """Labels of a page that marks its article or main element: which nodes hold main text. None: it marks none."""
    n = len(page.tag)
    inside, out = np.zeros(n, bool), np.zeros(n, bool)
    for k in range(n):
        p = page.parent[k]
        roots = page.tag[k] in BODY or "main" in page.tokens[k]
        beside = page.tag[k] in ("nav", "footer", "aside", "form", "menu", "button", "select") or bool(page.tokens[k] & BESIDE)
        inside[k] = (p >= 0 and inside[p] or roots) and not beside
    if not inside.any():
        return None
    for _, node, text, _ in page.pieces:
        out[node] |= inside[node] and bool(text.strip())
    for k in range(n - 1, 0, -1):
        out[page.parent[k]] |= out[k]
    return out


class Boosted:
    """Gradient-boosted regression trees on the logistic loss; each is a full tree of DEPTH levels."""

    def __init__(self) -> None:
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
            out += value[at - (2 ** DEPTH - 1)]
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
        rate = float(np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3))
        self.base = float(np.log(rate / (1 - rate)))
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
        score = np.full(len(x), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (y - p), weight * p * (1 - p) + 1e-9
            feature, cut, at = np.zeros(2 ** DEPTH - 1, int), np.full(2 ** DEPTH - 1, np.inf), np.zeros(len(x), int)
            for node in range(2 ** DEPTH - 1):
                rows = np.flatnonzero(at == node)
                best = (1e-6, 0, np.inf)
                if len(rows) >= 20:
                    gs, hs = g[rows].sum(), h[rows].sum()
                    for f, c in enumerate(cuts):
                        if not len(c):
                            continue
                        b = binned[rows, f]
                        gl = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
                        hl = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
                        gain = gl ** 2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs ** 2 / (hs + 1)
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (gain[k], f, c[k])
                feature[node], cut[node] = best[1:]
                at[rows] = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            leaf = at - (2 ** DEPTH - 1)
            value = RATE * np.bincount(leaf, g, 2 ** DEPTH) / (np.bincount(leaf, h, 2 ** DEPTH) + 1)
            self.trees.append((feature, cut, value))
            score += value[leaf]
        return self


def train(pages: DataFrame, rows: int = TRAIN_PAGES) -> Boosted | None:
    """Fit on about ``rows`` pages that mark their main text; None if there are none."""
    n = pages.count()
    draw = F.pmod(F.xxhash64(F.lit("pages"), "page_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for page_id, source in zip(b["page_id"], b["html"]):
                page = parse(source)
                y = marked(page)
                if y is None:
                    continue
                keep = np.random.default_rng(abs(int(page_id))).permutation(len(y))[:TRAIN_NODES]
                out.append((int(page_id), describe(page)[keep].tobytes(), y[keep].astype(np.uint8).tobytes()))
            yield pd.DataFrame(out, columns=["page_id", "x", "y"])

    some = pages.select("page_id", F.col("html").cast("string").alias("html")).filter(F.col("html").isNotNull() & F.col("page_id").isNotNull() & (draw < min(1.0, rows / max(n, 1))))
    got = sorted(some.mapInPandas(nodes, "page_id long, x binary, y binary").collect(), key=lambda r: (r["page_id"], bytes(r["x"])))
    if not got:
        return None
    x = np.concatenate([np.frombuffer(r["x"], np.float32).reshape(-1, len(FEATURES)) for r in got])
    y = np.concatenate([np.frombuffer(r["y"], np.uint8) for r in got]).astype(float)
    hidden = x.copy()
    hidden[:, NAMED] = 0
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    return Boosted().fit(np.concatenate([x, hidden]), np.concatenate([y, y]), np.concatenate([weight, 0.5 * weight]))


def judge(x: np.ndarray, model: Boosted | None) -> np.ndarray:
    """The log-odds that each node holds main text."""
    if model is not None:
        return model.raw(x)
    name = {f: x[:, k] for k, f in enumerate(FEATURES)}
    beside = np.maximum.reduce([name["beside"], name["beside_above"], name["chrome"], name["chrome_above"]])
    return np.where(beside > 0, -2.0, np.where(name["link_share"] > 0.5, -1.0, 1.0))


def decode(parent: list[int], odds: np.ndarray) -> np.ndarray:
    """The most likely labels in which kept nodes have kept ancestors."""
    keep, drop = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    choice = np.zeros(len(odds), bool)
    for k in range(len(odds) - 1, 0, -1):  # children before parents
        choice[k] = keep[k] > drop[k]
        keep[parent[k]] += max(keep[k], drop[k])
        drop[parent[k]] += drop[k]
    choice[0] = keep[0] > drop[0]
    for k in range(1, len(odds)):
        choice[k] &= choice[parent[k]]
    return choice


def main_text(page: Page, kept: np.ndarray) -> str:
    lines, now, on = [], [], None
    for block, node, text, _ in page.pieces:
        if block != on:
            lines.append("".join(now))
            now, on = [], block
        if kept[node]:
            now.append(text)
    lines.append("".join(now))
    return "\n".join(t for t in (_SPACE.sub(" ", line).strip() for line in lines) if t)


def extract(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of ``pages``."""
    prepare(pages.sparkSession)
    model = model or train(pages)

    @F.pandas_udf("string")
    def texts(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for sources in parts:
            out = []
            for at in range(0, len(sources), 64):  # the trees judge the nodes of many pages at once
                trees = [parse(s or "") for s in sources.iloc[at:at + 64]]
                x = [describe(t) for t in trees]
                odds = np.split(judge(np.concatenate(x), model), np.cumsum([len(r) for r in x])[:-1])
                out += [main_text(t, decode(t.parent, o)) for t, o in zip(trees, odds)]
            yield pd.Series(out, dtype=object)

    text = pages.select("page_id", "url", texts(F.coalesce(F.col("html").cast("string"), F.lit(""))).alias("text"))
    return text.withColumn("n_chars", F.char_length("text").cast("long"))


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
