"""Main text of web pages by gradient-boosted trees over DOM nodes with hierarchical decoding.

Each page is parsed into a tree, in time linear in its length however deep it is. A node's features are its tag, tokens
of its class and id, what its heading says, depth, the text, link and tag density of its subtree, statistics of its
siblings and children, and what its ancestors are. Boosted trees (trained here, on ``TRAIN_PAGES`` generated pages whose
nodes are labelled) give the chance that a node belongs to the main text. The decoder then picks the best labelling of the whole tree: a node is above the main text, in it, or out of it; below a
node that is out everything is out, so no descendant contradicts an ancestor.

Blocks are separated by block-level tags; white space inside a block becomes one space; character references are
decoded; blocks are joined in page order by line feeds.

Cases: a null or empty page has an empty text; a page cut off anywhere keeps what it has up to there (a tag that is
cut off is dropped); a null page_id or url is kept; repeated rows are extracted alike; an empty table gives an empty
result; other columns are ignored. No shuffle; the model is a few kilobytes whatever the input.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import per_batch

#: The bound of the training sample: generated pages, none of the input.
TRAIN_PAGES, TREES, DEPTH, RATE, BINS, LEAF = 800, 50, 5, 0.25, 32, 4

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, up to their end tag; and elements with markup in them that is no text of the page.
RAW = frozenset("script style textarea iframe".split())
MUTE = frozenset("svg select template noscript".split())
BLOCK = frozenset("html head body title address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul option".split())
CLOSES_P = BLOCK - frozenset("head body html title td th tr tbody thead tfoot option".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BARRIER = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?>[^>"']++|"[^"]*"|'[^']*')*+)(>|\Z)|/?(?:[a-zA-Z].*)?\Z)""", re.S)
MARK = re.compile(r"data-y=([01])")
ATTR = re.compile(r"""(?:class|id|role|itemprop|itemtype)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

TAGS = {t: i for i, t in enumerate("p div article section main h1 h2 h3 h4 h5 h6 li ul ol a span b strong em td th tr table tbody thead caption dl dt dd figure figcaption nav aside footer header form button label head title blockquote pre code details summary time cite body html".split(), 1)}
#: Groups of tags that are a feature each: a tag's number has no order that a cut could use.
KINDS = ("article main", "h1 h2", "h3 h4 h5 h6", "p", "section", "div", "b strong em span code", "table tbody thead tr td th caption", "ul ol li dl dt dd", "figure figcaption blockquote pre", "nav footer header form aside button label")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 legend".split())
#: What tokens of attributes say: groups that bear on a node for and against being main text.
TOKENS = {
    "content": "content article post entry story main text body prose articlebody page hentry blog",
    "ad": "ad ads adv advert advertisement banner sponsor sponsored promo promoted adsense dfp",
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs pagination pager tabs toc links toolbar",
    "comment": "comment comments reply replies discussion disqus respond reader readers",
    "side": "sidebar side aside widget related recommended recommend popular trending more teaser",
    "foot": "footer foot copyright legal bottom colophon",
    "head": "header head masthead top logo site branding",
    "notice": "cookie cookies consent notice alert gdpr popup modal overlay newsletter subscribe signup login share social form search",
}
#: What headings say of what they stand over.
SAYS = {
    "comment": "comment comments reply replies responses discussion kommentar kommentare commentaire commentaires comentario comentarios réactions respuestas",
    "side": "related recommended similar popular trending more also latest mehr ähnliche auch aussi articles más también recientes",
    "notice": "advertisement anzeige publicité publicidad sponsored cookies newsletter subscribe share privacy login search",
}
_SAY = {t: k for k, ts in enumerate(SAYS.values()) for t in ts.split()}
_TOKEN = {t: k for k, ts in enumerate(TOKENS.values()) for t in ts.split()}
_OUT = {t: i for i, t in enumerate(("nav", "aside", "footer", "header", "form", "a", "head"))}
_IN = {"article": 0, "main": 1}


class Page:
    """The nodes of a page in page order; the subtree of node i is i up to end[i]."""

    __slots__ = ("tag", "parent", "end", "own", "tokens", "says", "marks", "events", "_open")

    def __init__(self, text: str, marked: bool = False):
        self.tag, self.parent, self.end, self.own, self.tokens, self.says, self.marks = ["#"], [-1], [0], [0], [0], [0], [0]
        #: (node, text) in page order; text None is a block boundary.
        self.events: list[tuple[int, str | None]] = []
        #: How many elements of each name are open, so that nothing is looked for in the stack that is not there.
        self._open: Counter[str] = Counter()
        stack, at, find = [0], 0, TAG.search
        tag, events, is_open = self.tag, self.events, self._open
        while m := find(text, at):
            if m.start() > at:
                self._text(stack[-1], text[at : m.start()])
            at = m.end()
            name = m[2]
            if name is None or m[4] != ">":
                continue  # a comment, a declaration, or a tag that is cut off
            name = name.lower()
            if m[1]:
                if is_open[name]:
                    while tag[stack[-1]] != name:
                        self._close(stack)
                    self._close(stack)
                if name in BLOCK:
                    events.append((stack[-1], None))
                continue
            if name in CLOSES_P:
                self._end_open(stack, ("p",), ("td", "th", "li", "table", "article", "div", "section", "body"))
            if name in CLOSES:
                self._end_open(stack, CLOSES[name], BARRIER[name])
            node = len(tag)
            if name in BLOCK:
                events.append((stack[-1] if name in VOID else node, None))
            elif name == "br":
                self._text(stack[-1], " ")
            if name in VOID:
                continue
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(text, at)
                at = close.end() if close else len(text)
                continue
            if name in MUTE and m[3].endswith("/"):
                continue
            tag.append(name)
            self.parent.append(stack[-1])
            self.end.append(0)
            self.own.append(0)
            self.says.append(0)
            bits = 0
            if m[3] and not m[3].isspace():
                for a in ATTR.findall(m[3]):
                    for t in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", "".join(a)).lower()):
                        if t in _TOKEN:
                            bits |= 1 << _TOKEN[t]
            self.tokens.append(bits)
            mark = self.marks[stack[-1]]
            if marked and (got := MARK.search(m[3])):
                mark = int(got[1])
            self.marks.append(mark)
            is_open[name] += 1
            stack.append(node)
        if at < len(text):
            self._text(stack[-1], text[at:])
        while stack:
            self._close(stack)

    def _text(self, node: int, text: str) -> None:
        if any(self._open[name] for name in MUTE):
            return
        self.events.append((node, text))
        self.own[node] += len(text.strip())
        if self.tag[node] in HEADINGS:
            for t in re.split(r"[\W\d_]+", text.lower()):
                if t in _SAY:
                    self.says[node] |= 1 << _SAY[t]

    def _close(self, stack: list[int]) -> None:
        node = stack.pop()
        self.end[node] = len(self.tag)
        self._open[self.tag[node]] -= 1

    def _end_open(self, stack: list[int], names: tuple, barrier: tuple) -> None:
        """Close the innermost open element of these names, unless a barrier stands before it."""
        if not any(self._open[name] for name in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            i = stack[k]
            if self.tag[i] in names:
                while stack[-1] != i:
                    self._close(stack)
                self._close(stack)
                self.events.append((stack[-1], None))
                return
            if self.tag[i] in barrier:
                return


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    """The features of all nodes of the pages, and where each page begins."""
    sizes = np.array([len(p.tag) for p in pages])
    base = np.concatenate([[0], np.cumsum(sizes)])
    n = int(base[-1])
    shift = np.repeat(base[:-1], sizes)
    flat = lambda name, kind=np.int64: np.fromiter((x for p in pages for x in getattr(p, name)), kind, n)
    parent, end, own, tokens, says = flat("parent"), flat("end") + shift, flat("own"), flat("tokens"), flat("says")
    names = [t for p in pages for t in p.tag]
    tag = np.fromiter((TAGS.get(t, 0) for t in names), np.int64, n)
    root = parent < 0
    up = np.where(root, np.arange(n), parent + shift)
    i = np.arange(n)

    def below(x: np.ndarray) -> np.ndarray:
        s = np.concatenate([[0], np.cumsum(x)])
        return s[end] - s[i]

    def above(x: np.ndarray) -> np.ndarray:
        """How many ancestors or the node itself have x."""
        d = np.zeros(n + 1, np.int64)
        np.add.at(d, i[x], 1)
        np.add.at(d, end[x], -1)
        return np.cumsum(d)[:n]

    is_a, is_p = tag == TAGS["a"], tag == TAGS["p"]
    heading = np.isin(tag, [TAGS[h] for h in HEADINGS if h in TAGS])
    text = below(own)
    linked = below(np.where(above(is_a) > 0, own, 0))
    tags = end - i
    depth = above(np.ones(n, bool)) - 1
    whole = np.maximum(np.repeat(text[base[:-1]], sizes), 1)
    by_parent = lambda x: np.bincount(up[~root], weights=x[~root], minlength=n)
    kids, kid_text, kid_p = by_parent(np.ones(n)), by_parent(text), by_parent(is_p)
    order = np.lexsort((i, up))
    place = np.empty(n, np.int64)
    first = np.concatenate([[True], np.diff(up[order]) > 0]) if n else np.zeros(0, bool)
    place[order] = i - np.maximum.accumulate(np.where(first, i, 0))
    kin = up * 64 + tag
    _, which, many = np.unique(kin, return_inverse=True, return_counts=True)
    alike = np.zeros(n)
    np.maximum.at(alike, up, many[which])
    before = np.concatenate([[0], np.cumsum(own)])[i] - np.repeat(np.concatenate([[0], np.cumsum(own)])[base[:-1]], sizes)
    # children that begin with a short name and have little else, as comments do
    names_it = np.isin(tag, [TAGS[t] for t in "b strong span a cite em h4 h5 h6 time".split()]) & (text < 40) & (text > 0)
    led = np.zeros(n, bool)
    led[up[names_it & (place <= 1) & ~root]] = True
    led &= (kids >= 2) & (kids <= 5) & ~np.isin(tag, [TAGS[t] for t in ("p", "li", "td", "tr", "ul")])
    leads = by_parent(led)
    # what the first heading of a node's children says
    say = says.copy()
    heads = np.flatnonzero(heading)[::-1]
    say[up[heads]] |= 0
    for h in heads.tolist():  # the first one is written last
        if place[h] <= 1:
            say[up[h]] = says[h]
    cols = [
        tag, tag[up], tag[up[up]], depth, own, text, text / whole, before / whole, tags, text / tags, linked / np.maximum(text, 1),
        kids, kid_p, kid_p[up], kids[up], place, many[which], text / np.maximum(kid_text[up], 1), own / np.maximum(text, 1), below(is_p), below(is_a),
        alike / np.maximum(kids, 1), kid_text / np.maximum(kids, 1), leads / np.maximum(kids, 1), (leads / np.maximum(kids, 1))[up], below(heading), led,
    ]
    cols += [np.isin(tag, [TAGS[t] for t in ts.split()]) for ts in KINDS]
    for k in range(len(TOKENS)):
        has = (tokens >> k & 1).astype(bool)
        cols += [has, above(has) - has, below(has) - has]
    for k in range(len(SAYS)):
        has = (say >> k & 1).astype(bool)
        cols += [has, above(has) - has]
    for t in (*_OUT, *_IN):
        has = tag == TAGS[t]
        cols.append(above(has) - has)
    cols.append(below(np.isin(tag, [TAGS["article"], TAGS["main"]])))
    return np.column_stack(cols).astype(np.float32), base


# --- boosted trees


class Trees:
    """Gradient-boosted trees for a binary target, on histograms; a tree is complete, so a node's children are 2i+1, 2i+2."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE):
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
        b = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)])
        self.depth, self.trees = depth, []
        p0 = np.clip(np.average(y, weights=w), 0.01, 0.99)
        self.start = float(np.log(p0 / (1 - p0)))
        score = np.full(len(y), self.start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            feature, cut, value, leaf = self._grow(b, w * (p - y), w * np.maximum(p * (1 - p), 1e-6), rate)
            self.trees.append((feature, cut, value))
            score += value[leaf]

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, rate: float):
        n, m = b.shape
        size = (1 << (self.depth + 1)) - 1
        feature, cut, value = np.zeros(size, np.int32), np.full(size, np.inf), np.zeros(size)
        at = np.zeros(n, np.int64)
        for d in range(self.depth):
            lo, width = (1 << d) - 1, 1 << d
            local = at - lo
            best = np.full(width, 1e-9)
            split = np.full((width, 2), -1)
            for j in range(m):
                k = local * (BINS + 1) + b[:, j]
                gs, hs = (np.bincount(k, weights=v, minlength=width * (BINS + 1)).reshape(width, -1)[:, : BINS + 1].cumsum(axis=1) for v in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < LEAF) | (ht - hs < LEAF)] = 0
                c = gain.argmax(axis=1)
                top = gain[np.arange(width), c]
                hit = top > best
                best[hit] = top[hit]
                split[hit] = np.column_stack([np.full(hit.sum(), j), c[hit]])
            for node in range(width):
                j, c = split[node]
                if j >= 0 and c < len(self.cuts[j]):
                    feature[lo + node], cut[lo + node] = j, self.cuts[j][c]
            go = np.zeros(n, bool)
            has = split[local, 0] >= 0
            go[has] = b[has, split[local[has], 0]] > split[local[has], 1]
            at = 2 * at + 1 + go
        lo = (1 << self.depth) - 1
        gl, hl = (np.bincount(at - lo, weights=v, minlength=1 << self.depth) for v in (g, h))
        value[lo:] = -rate * gl / (hl + 1)
        return feature, cut, value, at

    def chance(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            score += value[at]
        return 1 / (1 + np.exp(-score))


def decode(page: Page, p: np.ndarray) -> list[bool]:
    """Which nodes are in the main text: the labelling with the best total score of all that keep to the hierarchy.

    Scores are log chances, weighted by a node's own text so that words count, not tags."""
    n = len(p)
    eps = 1e-6
    inside, outside, over = [0.0] * n, [0.0] * n, [0.0] * n
    yes, no = np.log(p + eps).tolist(), np.log(1 - p + eps).tolist()
    weight = [1.0 + x**0.5 for x in page.own]
    for i in range(n - 1, -1, -1):
        inside[i] += weight[i] * yes[i]
        outside[i] += weight[i] * no[i]
        over[i] += weight[i] * no[i]
        if (u := page.parent[i]) >= 0:
            inside[u] += max(inside[i], outside[i])
            outside[u] += outside[i]
            over[u] += max(over[i], inside[i], outside[i])
    label = [0] * n  # 0 above, 1 in, 2 out
    for i in range(1, n):
        above = label[page.parent[i]]
        if above == 2:
            label[i] = 2
        elif above == 1:
            label[i] = 1 if inside[i] >= outside[i] else 2
        elif inside[i] >= max(over[i], outside[i]):
            label[i] = 1
        else:
            label[i] = 0 if over[i] >= outside[i] else 2
    return [x == 1 for x in label]


def assemble(page: Page, keep: list[bool]) -> str:
    blocks, parts = [], []
    for node, text in [*page.events, (0, None)]:
        if text is not None:
            if keep[node]:
                parts.append(text)
        elif parts:
            if line := " ".join(entities.unescape("".join(parts)).split()):
                blocks.append(line)
            parts = []
    return "\n".join(blocks)


# --- training pages

_SYLLABLES = "ba de ti on er la schi pro ñu éa ing".split()


def _words(r: random.Random, lo: int, hi: int) -> str:
    return " ".join("".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(lo, hi)))


def _named(r: random.Random, *names: str) -> str:
    return r.choice([f' class="{r.choice(names)}"', f' id="{r.choice(names)}"'])


def _links(r: random.Random, lo: int, hi: int) -> str:
    return "".join(f'<li><a href="/{i}">{_words(r, 1, 3)}</a></li>' for i in range(r.randint(lo, hi)))


def _said(r: random.Random, kind: str) -> str:
    """A heading over something of this kind, in one of four languages."""
    word = r.choice(SAYS[kind].split())
    return r.choice([word.capitalize(), f"{word.capitalize()} ({r.randint(1, 99)})", f"{_words(r, 1, 2)} {word}"])


def comments(r: random.Random) -> str:
    """Reader comments: by name of class, by heading, or by nothing but their form."""
    tag, inner, who = r.choice(["section", "div", "ul"]), r.choice(["div", "article", "li"]), r.choice(["b", "strong", "span", "cite", "h4"])
    cue = r.random()
    own = _named(r, "comments", "comment-list", "discussion", "replies") if cue < 0.5 else ""
    each = ' class="comment"' if cue < 0.35 else ""
    head = f"<h{r.choice('234')}>{_said(r, 'comment') if cue > 0.4 else _words(r, 1, 2)}</h3>" if cue > 0.15 else ""
    one = lambda: f"<{inner}{each}><{who}>{_words(r, 1, 2)}</{who}>{r.choice(['', '<time>' + _words(r, 1, 1) + '</time>'])}<p>{_words(r, 2, 40)}</p></{inner}>"
    return f"<{tag}{own} data-y=0>{head}{''.join(one() for _ in range(r.randint(1, 6)))}</{tag}>"


def junk(r: random.Random) -> str:
    """Something that is not of the article though it may stand in it."""
    w = lambda lo, hi: _words(r, lo, hi)
    return r.choice([
        lambda: f'<div{_named(r, "ad", "ads", "advert", "banner", "sponsored", "promo")} data-y=0>{w(2, 25)}</div>',
        lambda: f'<div{_named(r, "cookie", "cookie-notice", "consent", "notice", "alert")} data-y=0><p>{w(4, 20)}</p><button>{w(1, 2)}</button></div>',
        lambda: f'<form action="/s" data-y=0><label>{w(1, 3)}</label><input name=q><select><option>{w(1, 2)}</select><button>{w(1, 2)}</button></form>',
        lambda: f'<div{_named(r, "share", "social", "newsletter", "subscribe")} data-y=0><p>{w(2, 12)}</p><a href="#">{w(1, 2)}</a></div>',
        lambda: f'<div{_named(r, "related", "recommended", "popular", "more")} data-y=0><h3>{w(1, 4)}</h3><ul>{_links(r, 2, 6)}</ul></div>',
        lambda: f'<div data-y=0><h3>{_said(r, "side")}</h3><ul>{_links(r, 2, 6)}</ul></div>',
        lambda: f'<section data-y=0><h4>{_said(r, "notice")}</h4><p>{w(2, 20)}</p></section>',
        lambda: f'<aside data-y=0>{r.choice([f"<h3>{w(1, 3)}</h3>", ""])}<p>{w(3, 30)}</p></aside>',
        lambda: f"<aside data-y=0>{w(3, 20)}</aside>",
        lambda: f"<nav data-y=0><ol>{_links(r, 2, 6)}</ol></nav>",
    ])()


def _inline(r: random.Random, text: str) -> str:
    tag = r.choice(["b", "em", "strong", "span", "i", "code"])
    return r.choice([f"<a href=x>{text}</a>", f"<{tag}>{text}</{tag}>"])


def article(r: random.Random) -> str:
    """The blocks of an article, with what may stand between them."""
    w = lambda lo, hi: _words(r, lo, hi)
    end = lambda tag: f"</{tag}>" if r.random() < 0.9 else ""

    def paragraph() -> str:
        k = r.random()
        if k < 0.3:
            return f"<p>{w(2, 40)} {_inline(r, w(1, 3))} {w(1, 30)}{end('p')}"
        if k < 0.4:
            return f"<p><b>{r.choice([w(2, 40), w(1, 4)])}<br>{r.choice([w(1, 30), ''])}{end('p')}"
        return f"<p>{w(2, 40) if k < 0.75 else w(1, 5)}{end('p')}"

    def table() -> str:
        cell = lambda t: f"<{t}>{r.choice([w(1, 4), str(r.randint(0, 9999)), _inline(r, w(1, 2)), f'<p>{w(1, 8)}</p>'])}{end(t)}"
        width = r.randint(2, 5)
        rows = "".join(f"<tr>{''.join(cell('td') for _ in range(width))}{end('tr')}" for _ in range(r.randint(1, 6)))
        head = f"<thead><tr>{''.join(cell('th') for _ in range(width))}</tr></thead>" if r.random() < 0.5 else ""
        body = f"<tbody>{rows}</tbody>" if r.random() < 0.5 else rows
        return f"<table>{f'<caption>{w(1, 6)}</caption>' if r.random() < 0.3 else ''}{head}{body}</table>"

    blocks = [
        (0.62, paragraph),
        (0.69, lambda: f"<{(h := r.choice(['h2', 'h3', 'h4']))}>{w(1, 6)}</{h}>"),
        (0.74, lambda: f"<{(t := r.choice(['ul', 'ol']))}>{''.join(f'<li>{r.choice([w(1, 12), _inline(r, w(1, 3)) + " " + w(1, 9)])}{end("li")}' for _ in range(r.randint(2, 6)))}</{t}>"),
        (0.79, table),
        (0.82, lambda: f"<dl>{''.join(f'<dt>{w(1, 3)}{end("dt")}<dd>{w(1, 12)}{end("dd")}' for _ in range(r.randint(1, 5)))}</dl>"),
        (0.86, lambda: f"<figure>{r.choice(['<img src=x.jpg>', '<svg><text>z</text></svg>'])}<figcaption>{w(2, 15)}</figcaption></figure>"),
        (0.89, lambda: f"<blockquote>{r.choice([w(3, 20), f'<p>{w(3, 20)}</p><cite>{w(1, 3)}</cite>'])}</blockquote>"),
        (0.91, lambda: f"<pre><code>{w(2, 20)}</code></pre>"),
        (1.0, lambda: junk(r)),
    ]
    body = []
    if r.random() < 0.85:
        title = f"<h1>{w(2, 9)}</h1>"
        body.append(f"<header>{title}<p>{w(2, 6)}</p></header>" if r.random() < 0.12 else title)
        if r.random() < 0.5:
            body.append(paragraph())
    for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8, 14])):
        k = r.random()
        body.append(next(make for most, make in blocks if k < most)())
        if r.random() < 0.04:
            body.append(f"<section>{w_block}</section>" if (w_block := paragraph()) else "")
    return "".join(body)


def training_page(r: random.Random) -> str:
    """A page as markup. ``data-y`` says where the main text begins and what in it is not: the features do not see it."""
    w = lambda lo, hi: _words(r, lo, hi)
    body, after = article(r), []
    talk = comments(r) if r.random() < 0.4 else ""
    if talk and r.random() < 0.4:
        body += talk
    elif talk:
        after.append(talk)
    shell = r.random()
    if shell < 0.5:
        text = f"<article data-y=1>{body}</article>"
    elif shell < 0.65:
        text = f"<main data-y=1>{body}</main>"
    else:
        text = f'<div{_named(r, "content", "post", "entry-content", "article-body", "story", "main", "x7", "c1")} data-y=1>{body}</div>'
    if r.random() < 0.15 and shell < 0.5:
        text = f"<main>{text}{after.pop() if after else ''}</main>"
    elif r.random() < 0.3:
        text = f'<div class="{r.choice(["wrap", "container", "page", "row"])}">{text}{after.pop() if after and r.random() < 0.5 else ""}</div>'
    before = [f"<nav><ul>{_links(r, 2, 8)}</ul></nav>" if r.random() < 0.7 else f'<div{_named(r, "menu", "nav", "navbar", "breadcrumb")}><ul>{_links(r, 2, 8)}</ul></div>']
    if r.random() < 0.4:
        before.insert(0, f'<header><a href="/">{w(1, 3)}</a><p>{w(2, 6)}</p></header>' if r.random() < 0.6 else f'<div{_named(r, "header", "masthead", "top")}><h2>{w(1, 4)}</h2></div>')
    if r.random() < 0.4:
        (before if r.random() < 0.3 else after).append(f"<aside><h3>{w(1, 3)}</h3><p>{w(4, 25)}</p></aside>" if r.random() < 0.6 else f'<div{_named(r, "sidebar", "side", "widget")}><p>{w(4, 30)}</p><ul>{_links(r, 1, 5)}</ul></div>')
    for _ in range(r.randint(0, 3)):
        (before if r.random() < 0.5 else after).append(junk(r))
    after.append(f"<footer>&copy; {w(2, 20)}</footer>" if r.random() < 0.8 else f'<div{_named(r, "footer", "copyright", "legal")}><p>{w(2, 14)}</p></div>')
    head = f"<!DOCTYPE html><html><head><title>{w(2, 8)}</title><style>p{{}}</style></head><body>{''.join(before)}"
    page = f"{head}{text}{''.join(after)}</body></html>"
    if r.random() < 0.25:  # cut off, perhaps before the article begins, or soon after
        page = page[: r.choice([r.randint(100, len(page)), len(head) + r.randint(20, 200)])]
    return page


def marked_text(page: str) -> str:
    """The main text of a page whose elements are marked."""
    p = Page(page, marked=True)
    return assemble(p, [m == 1 for m in p.marks])


@lru_cache(maxsize=1)
def model(pages: int = TRAIN_PAGES, seed: int = 5) -> Trees:
    r = random.Random(seed)
    done = [Page(training_page(r), marked=True) for _ in range(pages)]
    x, _ = features(done)
    w = np.concatenate([1 + np.sqrt(np.array(p.own)) for p in done])
    return Trees(x, np.concatenate([np.array(p.marks, float) for p in done]), w / w.mean())


def main_texts(htmls: list[str | None], trees: Trees) -> list[str]:
    pages = [Page(h or "") for h in htmls]
    if not pages:
        return []
    x, base = features(pages)
    p = trees.chance(x)
    return [assemble(page, decode(page, p[a:b])) for page, a, b in zip(pages, base[:-1], base[1:], strict=True)]


def _extract(batch: pa.RecordBatch, trees: Trees) -> dict:
    text = main_texts(batch.column("html").to_pylist(), trees)
    return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": text, "n_chars": list(map(len, text))}


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, main text and its length in code points."""
    return per_batch(pages.select("page_id", "url", "html"), _extract, "page_id long, url string, text string, n_chars long", trees=model())


def op5_main_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
