"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page becomes a tree of block elements; text is kept in runs between block boundaries.  Every block has features of its
subtree (text, link density, tags per text), of its tokens (tag, class, id, role: each token counts as the log-odds that
it had in training, for the block and for its ancestors), of its depth and place, and of its siblings.  Boosted trees
score each block; decoding over the tree then chooses, from the leaves up, among keeping a subtree whole,
dropping it whole, and letting the children decide at a price, so no kept block lies in a subtree that is dropped whole.

There are no labels of blocks.  The model is fitted on at most ``SAMPLE`` pages with an ``article`` or ``main`` element, which gives the truth,
and on the same texts dressed in other layouts (`dressed`), so that it doesn't rest on one tag.

Defined cases: null and empty pages and pages without text give an empty text; repeated rows give equal texts; without any page to learn
from, the layouts are dressed with the texts of paragraphs; broken markup is read as browsers do, roughly: unknown end tags are skipped,
paragraphs, list items and cells end where the next begins, unclosed raw elements run to the end, a ``<`` whose tag never ends is text.
Very long, broad, deep or broken pages take time and memory in proportion to their length.  A page is one row, read whole by one task.
"""

from __future__ import annotations

import html
import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, DRESSES = 300, 3
TREES, DEPTH, BINS, RATE = 60, 3, 32, 0.25
PRICE = 1.0
BATCH_PAGES, SCORED = 64, 8192

# Elements of HTML by the way they take part in text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg select object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead"), "td": ("table", "tr"), "th": ("table", "tr")}
#: block elements that end an open paragraph
ENDS_P = frozenset("address article aside blockquote center div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

#: for the tags that end open blocks: (blocks that they end, blocks beyond which they don't look)
ENDS = {name: (("p",), ("td", "th", "table", "body")) for name in sorted(ENDS_P)} | {name: (ended, STOPS.get(name, ())) for name, ended in CLOSES.items() if name != "p"}

START = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z]))")
NAME = re.compile(r"[^\s/>]*+")
REST = re.compile(r"((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>", re.S)
SPECIAL = re.compile(r"[\"'>]")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
TOKEN = re.compile(r"[a-z]+")


@dataclass
class Block:
    tag: str
    parent: Block | None
    depth: int
    tokens: list[str]
    children: list[Block] = field(default_factory=list)
    #: (order, text, characters of it in links)
    runs: list[tuple[int, str, int]] = field(default_factory=list)
    number: int = -1


class Tags:
    """Tags of a page, one after the other, in time linear in the page, whatever is left open.

    A tag ends at the first ``>`` outside quotes.  What looks like a tag but has no such end is text.  Where one has none, the ends for
    the rest of the page are found in one sweep from its end, so no later one is searched for in vain.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = page.rfind(">")
        self.dead = 0
        self.places: list[int] | None = None
        self.ends: list[int] = []

    def _sweep(self, at: int) -> None:
        self.places = [m.start() for m in SPECIAL.finditer(self.page, at)]
        self.ends = [-1] * (len(self.places) + 1)
        after = {}
        for k in range(len(self.places) - 1, -1, -1):
            c = self.page[self.places[k]]
            if c == ">":
                self.ends[k] = self.places[k]
            else:
                self.ends[k] = self.ends[after[c] + 1] if c in after else -1
                after[c] = k

    def _end(self, at: int) -> int:
        """Place of the ``>`` that ends the tag whose attributes begin at ``at``, or -1."""
        if self.places is None:
            m = REST.match(self.page, at)
            if m:
                return m.end() - 1
            self._sweep(at)
        return self.ends[bisect_left(self.places, at)]

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, name, closing, attributes) of the first tag from ``at`` on; comments and declarations have no name."""
        page = self.page
        while m := START.search(page, at):
            at = m.end()
            if m.group(1):
                stop = page.find("-->", at)
                return m.start(), stop + 3 if stop >= 0 else len(page), "", False, ""
            if at > self.last:
                continue
            if m.group(2):
                return m.start(), page.index(">", at) + 1, "", False, ""
            if at <= self.dead:
                continue
            named = NAME.match(page, at).end()
            end = self._end(named)
            if end >= 0:
                return m.start(), end + 1, page[at - 1 : named].lower(), bool(m.group(3)), page[named:end]
            self.dead = named
        return None


def tree(page: str | None) -> list[Block]:
    """Blocks of a page, parents before children; the first is the root."""
    root = Block("#page", None, 0, ["#page"])
    blocks, at, links, order = [root], 0, 0, 0
    here = root
    page = page or ""
    tags = Tags(page)
    #: the blocks from the root to here, by tag
    path: dict[str, list[Block]] = {}
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal order, linked
        if text:
            s = " ".join(html.unescape("".join(text)).split())
            if s:
                here.runs.append((order, s, min(linked, len(s))))
                order += 1
            text.clear()
            linked = 0

    def leave(b: Block) -> None:
        nonlocal here
        while here is not b.parent:
            path[here.tag].pop()
            here = here.parent

    def deepest(names: tuple[str, ...]) -> Block | None:
        return max((path[t][-1] for t in names if path.get(t)), key=lambda b: b.depth, default=None)

    while at < len(page):
        tag = tags.next(at)
        end = tag[0] if tag else len(page)
        if end > at:
            part = page[at:end]
            text.append(part)
            if links:
                linked += len(part.strip())
        if not tag:
            break
        _, at, name, closing, attributes = tag
        if not name:
            continue
        if name in RAW:
            if not closing and not attributes.rstrip().endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
                at = page.find(">", stop.start()) + 1 or len(page) if stop else len(page)
            continue
        if name in INLINE:
            if name == "a":
                links = 0 if closing else 1
            elif name == "br":
                text.append(" ")
            continue
        flush()
        if closing:
            if path.get(name):
                leave(path[name][-1])
                links = 0
            continue
        if name in VOID:
            continue
        if name in ENDS:
            ended, barrier = map(deepest, ENDS[name])
            if ended is not None and (barrier is None or ended.depth > barrier.depth):
                leave(ended)
        links = 0
        tokens = ["<" + name]
        for a in ATTRIBUTE.findall(attributes):
            tokens += TOKEN.findall((a[1] or a[2] or a[3]).lower())
        b = Block(name, here, here.depth + 1, tokens)
        here.children.append(b)
        blocks.append(b)
        path.setdefault(name, []).append(b)
        here = b
    flush()
    for i, b in enumerate(blocks):
        b.number = i
    return blocks


def features(blocks: list[Block], odds: dict[str, float]) -> np.ndarray:
    """One row per block."""
    n = len(blocks)
    own = np.array([sum(len(r[1]) for r in b.runs) for b in blocks], float)
    linked = np.array([sum(r[2] for r in b.runs) for b in blocks], float)
    ends = np.array([sum(r[1].count(".") + r[1].count(",") for r in b.runs) for b in blocks], float)
    chars, links, stops, tags = own.copy(), linked.copy(), ends.copy(), np.ones(n)
    same = Counter((b.parent.number, b.tag) for b in blocks if b.parent is not None)
    for b in reversed(blocks):
        if b.parent is not None:
            p, i = b.parent.number, b.number
            chars[p] += chars[i]
            links[p] += links[i]
            stops[p] += stops[i]
            tags[p] += tags[i]
    out = np.zeros((n, 18))
    total = max(chars[0], 1.0)
    passed = np.cumsum(own) - own
    above = [(0.0, 0.0)] * n
    for b in blocks:
        i = b.number
        scores = [odds.get(t, 0.0) for t in b.tokens]
        low, high = min(scores), max(scores)
        p = b.parent
        up = above[p.number] if p is not None else (0.0, 0.0)
        above[i] = (min(up[0], low), max(up[1], high))
        # sums over all children of the parent, b among them
        k = p.number if p is not None else 0
        family, linked_family = (chars[k] - own[k], links[k] - linked[k]) if p is not None else (chars[0], links[0])
        brothers, alike = (len(p.children), same[k, b.tag]) if p is not None else (1, 1)
        density = links[i] / chars[i] if chars[i] else 0.0
        around = linked_family / family if family else 0.0
        out[i] = (scores[0], low, high, up[0], up[1], b.depth, len(b.children), math.log1p(chars[i]), math.log1p(own[i]), density, stops[i] / (chars[i] + 1),
                  tags[i] / (chars[i] + 10), chars[i] / total, passed[i] / total, brothers, alike / brothers, chars[i] / family if family else 0.0, around)
    return out


@dataclass
class Boosted:
    """Trees of one depth as arrays: node k of a tree has the children 2k+1 and 2k+2."""

    split: np.ndarray
    at: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores of rows, some thousand at a time, so that a page of very many blocks needs no large arrays."""
        return np.concatenate([self._score(x[at : at + SCORED]) for at in range(0, len(x), SCORED)] or [np.empty(0)])

    def _score(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.split))
        node = np.zeros((len(x), len(trees)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, self.split[trees, node]] > self.at[trees, node])
        return self.base + self.leaf[trees, node - (2**DEPTH - 1)].sum(axis=1)


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
    """Gradient boosting of the logistic loss with binned features and Newton leaves."""
    share = np.clip((y * weight).sum() / weight.sum(), 1e-6, 1 - 1e-6)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    out = Boosted(np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves)), float(np.log(share / (1 - share))))
    z = np.full(len(y), out.base)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h = (y - p) * weight, np.maximum(p * (1 - p), 1e-6) * weight
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                own = np.flatnonzero(node == k)
                best = (1e-6, None)
                if len(own) >= 8:
                    gs, hs = g[own].sum(), h[own].sum()
                    for f, e in enumerate(edges):
                        if not len(e):
                            continue
                        gl = np.cumsum(np.bincount(binned[own, f], g[own], len(e) + 1))[:-1]
                        hl = np.cumsum(np.bincount(binned[own, f], h[own], len(e) + 1))[:-1]
                        gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                        j = int(gain.argmax())
                        if gain[j] > best[0]:
                            best = (float(gain[j]), (f, e[j]))
                if best[1]:
                    out.split[t, k], out.at[t, k] = best[1]
                node[own] = 2 * k + 1 + (x[own, out.split[t, k]] > out.at[t, k])
        leaf = node - inner
        value = RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + 1)
        out.leaf[t] = value
        z += value[leaf]
    return out


def decode(blocks: list[Block], score: np.ndarray) -> np.ndarray:
    """Which blocks' own runs are kept.  Three choices per subtree: whole, nothing, or by the children at a price."""
    n = len(blocks)
    keep_all, best, choice = np.zeros(n), np.zeros(n), np.zeros(n, np.int8)
    by_children = np.zeros(n)
    for b in reversed(blocks):
        i = b.number
        own = score[i] * (1.0 if b.runs else 0.25)
        keep_all[i] += own
        split = by_children[i] + (abs(own) if b.runs else 0.0) - PRICE
        options = (keep_all[i], -keep_all[i], split if b.children else -math.inf)
        choice[i] = int(np.argmax(options))
        best[i] = options[choice[i]]
        if b.parent is not None:
            keep_all[b.parent.number] += keep_all[i]
            by_children[b.parent.number] += best[i]
    kept = np.zeros(n, bool)
    state = np.zeros(n, np.int8)
    for b in blocks:
        i = b.number
        state[i] = choice[i] if b.parent is None or state[b.parent.number] == 2 else state[b.parent.number]
        kept[i] = state[i] == 0 or (state[i] == 2 and score[i] > 0)
    return kept


@dataclass
class Model:
    odds: dict[str, float]
    boosted: Boosted

    def texts(self, pages: list[str | None]) -> list[str]:
        trees = [tree(p) for p in pages]
        scores = self.boosted.score(np.concatenate([features(t, self.odds) for t in trees])) if trees else np.empty(0)
        out, at = [], 0
        for t in trees:
            kept = decode(t, scores[at : at + len(t)])
            at += len(t)
            runs = sorted(r for b in t if kept[b.number] for r in b.runs)
            out.append(" ".join(r[1] for r in runs))
        return out


BOILERPLATE = ("nav", "aside", "footer", "header", "form", "button")


def truth(blocks: list[Block]) -> list[int] | None:
    """1 in the article, 0 outside, -1 where a subtree has both; None without an article."""
    top = next((b for b in blocks if b.tag == "article"), None) or next((b for b in blocks if b.tag == "main" or "main" in b.tokens), None)
    if top is None:
        return None
    out = [0] * len(blocks)
    for b in blocks:
        inside = b is top or (b.parent is not None and out[b.parent.number] == 1)
        out[b.number] = int(inside and b.tag not in BOILERPLATE)
    return mixed(blocks, out)


def mixed(blocks: list[Block], labels: list[int]) -> list[int]:
    some = [[False, False] for _ in blocks]
    for b in reversed(blocks):
        if b.runs:
            some[b.number][labels[b.number]] = True
        if b.parent is not None:
            for k in (0, 1):
                some[b.parent.number][k] |= some[b.number][k]
    return [-1 if all(s) else label for s, label in zip(some, labels, strict=True)]


def dressed(content: list[str], rest: list[str], rng: random.Random) -> str:
    """A page of another layout with the given texts.  Content blocks carry the attribute ``id="y"``, which training strips."""
    words = [w for s in rest + content for w in s.split()] or ["x"]
    say = lambda a, z: html.escape(" ".join(rng.choice(words) for _ in range(rng.randrange(a, z))))
    name = lambda *c: f' class="{rng.choice(c)}"' if rng.random() < 0.8 else f' id="{rng.choice(c)}"'
    items = lambda k: "".join(f'<li><a href="#">{say(1, 5)}</a></li>' for _ in range(rng.randrange(2, k)))

    def menu() -> str:
        return rng.choice(["<nav>{}</nav>", f"<div{name('menu', 'navbar', 'nav', 'navigation', 'breadcrumb')}>{{}}</div>"]).format(f"<ul>{items(10)}</ul>")

    def advert() -> str:
        return f"<div{name('ad', 'ads', 'advert', 'sponsor', 'promo', 'banner')}>{say(3, 25)}</div>"

    def notice() -> str:
        return f"<div{name('cookie notice', 'notice', 'consent', 'alert', 'popup', 'newsletter')}><p>{say(5, 30)}</p><button>{say(1, 3)}</button></div>"

    def form() -> str:
        return f"<form{name('search', 'login', 'subscribe', 'contact')}><label>{say(1, 5)}</label><input><p>{say(2, 12)}</p></form>"

    def side() -> str:
        return rng.choice(["<aside>{}</aside>", f"<div{name('sidebar', 'side', 'widget', 'related', 'rail')}>{{}}</div>"]).format(f"<h3>{say(1, 4)}</h3><ul>{items(8)}</ul><p>{say(3, 20)}</p>")

    def remarks() -> str:
        each = "".join(f"<div{name('comment', 'reply', 'response')}><h4>{say(1, 3)}</h4><p>{say(3, 60)}</p></div>" for _ in range(rng.randrange(1, 6)))
        return f"<{'section' if rng.random() < 0.5 else 'div'}{name('comments', 'discussion', 'responses')}><h3>{say(1, 3)}</h3>{each}</{'section' if False else 'div'}>"

    def body(s: str, k: int) -> str:
        s = html.escape(s)
        if k == 0:
            return f'<h1 id="y">{s}</h1>'
        r = rng.random()
        if r < 0.75:
            return f'<p id="y">{s}</p>'
        if r < 0.8:
            return f'<ul><li id="y">{s}</li></ul>'
        if r < 0.85:
            return f'<blockquote id="y"><p id="y">{s}</p></blockquote>'
        if r < 0.9:
            return f'<h2 id="y">{s}</h2>'
        return f'<div id="y">{s}</div>'

    parts = [body(s, k) for k, s in enumerate(content)]
    for make in (advert, side, form, notice):
        if rng.random() < 0.15 and parts:
            parts.insert(rng.randrange(1, len(parts) + 1), make())
    box = rng.choice(["article", "main", "section", "div", "div", "td"])
    inner = f"<{box}{name('content', 'post', 'entry', 'article', 'story', 'main', 'text', 'body') if rng.random() < 0.85 else ''}>{''.join(parts)}</{box}>"
    if box == "td":
        inner = f"<table><tr>{inner}</tr></table>"
    head = [f"<header{name('header', 'top', 'masthead')}><p>{say(1, 8)}</p></header>" if rng.random() < 0.5 else "", menu()]
    before = [f() for f in (advert, notice, side, form) if rng.random() < 0.35]
    after = [f() for f in (remarks, side, advert, form, menu, notice) if rng.random() < 0.35]
    foot = rng.choice(["<footer>{}</footer>", f"<div{name('footer', 'copyright', 'legal', 'bottom')}>{{}}</div>"]).format(f"&copy; {say(2, 20)}")
    wrap = ("<div" + name("wrapper", "container", "page", "layout") + ">", "</div>") if rng.random() < 0.5 else ("", "")
    return f"<html><head><title>{say(2, 8)}</title></head><body>{wrap[0]}{''.join(head + before)}{inner}{''.join(after)}{foot}{wrap[1]}</body></html>"


def marked(page: str) -> tuple[list[Block], list[int]]:
    blocks = tree(page)
    labels = [int(b.tokens[-1] == "y") for b in blocks]
    for b in blocks:
        if b.tokens[-1] == "y":
            b.tokens.pop()
    for b in reversed(blocks):  # a box without text of its own is content if all below it is
        if not b.runs and b.children:
            labels[b.number] = int(all(labels[c.number] for c in b.children))
    return blocks, mixed(blocks, labels)


def train(pages: list[str | None], seed: int = 1) -> Model:
    rng = random.Random(seed)
    cases = []
    for page in pages:
        blocks = tree(page)
        labels = truth(blocks)
        inside = [r for b in blocks for r in b.runs if (labels[b.number] == 1 if labels else b.tag in ("p", "h1"))]
        outside = [r for b in blocks for r in b.runs if (labels[b.number] == 0 if labels else b.tag not in ("p", "h1"))]
        if labels:
            cases.append((blocks, labels))
        if inside:
            for _ in range(DRESSES):
                cases.append(marked(dressed([r[1] for r in sorted(inside)], [r[1] for r in outside], rng)))
    seen: dict[str, list[float]] = {}
    for blocks, labels in cases:
        for b in blocks:
            if labels[b.number] >= 0:
                for t in set(b.tokens):
                    seen.setdefault(t, [1.0, 1.0])[labels[b.number]] += 1
    odds = {t: math.log(one / zero) for t, (zero, one) in seen.items() if zero + one > 6}
    rows, ys, weights = [], [], []
    for blocks, labels in cases:
        use = np.array([label >= 0 for label in labels])
        rows.append(features(blocks, odds)[use])
        ys += [label for label in labels if label >= 0]
        weights += [1.0 if b.runs else 0.5 for b, u in zip(blocks, use, strict=True) if u]
    if not rows or len(set(ys)) < 2:
        rows, ys, weights = [np.zeros((2, 18))], [0, 1], [1.0, 1.0]
    return Model(odds, boost(np.concatenate(rows), np.array(ys, float), np.array(weights)))


def fit(pages: DataFrame, sample: int = SAMPLE, column: str = "html") -> Model:
    """A model from a bounded sample of different pages, those with the smallest hashes: hashes are chosen first, then pages fetched."""
    rows = pages.where(F.col(column).isNotNull()).select(F.col(column).alias("html"), F.xxhash64(column).alias("_h"))
    chosen = [r._h for r in rows.select("_h").distinct().orderBy("_h").limit(sample).collect()]
    found = rows.where(F.col("_h").isin(chosen)).groupBy("_h").agg(F.min("html").alias("html")).collect() if chosen else []
    return train([r.html for r in sorted(found, key=lambda r: r._h)])


def extract(pages: DataFrame, model: Model, column: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``, in place of columns of these names."""
    sent = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = sent.value
        for s in batches:
            out: list[str] = []
            for at in range(0, len(s), BATCH_PAGES):
                out += model.texts(s.iloc[at : at + BATCH_PAGES].tolist())
            yield pd.Series(out, dtype=object)

    rows = pages.withColumn("text", main_text(F.coalesce(F.col(column), F.lit(""))))
    return rows.withColumn("n_chars", F.char_length("text").cast("long"))
