"""Main text of web pages: gradient-boosted trees over DOM nodes.

A page is parsed into a tree, by the rules of the HTML standard for tags,
attributes and omitted end tags, in time linear in its length; every element
gets features of its subtree (text, link and tag density), its attribute
tokens, its depth and its siblings.  An attribute token counts by how often
training elements that have it are main text.  Boosted trees say how likely it is part of the main text.  Decoding is over
the whole tree: an element can be main only where its parent is, and among all
such choices the most likely one is found by dynamic programming, so no
descendant of a rejected element is ever kept.

The trees are fitted here, with NumPy, on generated pages whose nodes are
labelled by how they were made: TRAIN_PAGES pages, a fixed bound.  The fitted
model is small and goes to the tasks with the function.

Blocks: character references are decoded, white space inside a block becomes
one space, blocks are trimmed and joined in page order by one line feed; empty
blocks give nothing.  Block elements and ``br`` begin new blocks.

Defined cases: null html is an empty page; an empty page or one without main
text gives an empty string; markup that never closes is closed by the end of
the page, a tag whose quote never closes by its next ``>``; a stray end tag is
passed over; text outside any element belongs to the body; very long pages are
read whole; repeated rows are alike; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TRAIN_PAGES = 1000
TREES = 80
DEPTH = 4
RATE = 0.25
BINS = 24
SEED = 6

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup; only that of xmp is shown as text, letter by letter.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Elements that never hold main text: what is not shown, and parts of forms.
HIDDEN = frozenset("head script style template iframe title textarea select option datalist noembed noframes".split())
HEAD = frozenset("head title meta link script style base noscript template".split())
BLOCK = frozenset("html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre xmp figure figcaption header footer nav aside form fieldset legend address details summary hr br center dialog search hgroup menu head title".split())
#: Kinds of elements whose end tag may be left out; each node knows the innermost open one of each kind in its scope.
PARAGRAPH, ITEM, TERM, ROW, CELL, OPTION, FOREIGN = range(7)
KIND = {"p": PARAGRAPH, "li": ITEM, "dt": TERM, "dd": TERM, "tr": ROW, "td": CELL, "th": CELL, "option": OPTION, "svg": FOREIGN, "math": FOREIGN}
#: Kinds that the key's content does not see.
NEW_SCOPE = {
    "table": (PARAGRAPH, ITEM, TERM, ROW, CELL), "td": (PARAGRAPH, ITEM, TERM), "th": (PARAGRAPH, ITEM, TERM), "caption": (PARAGRAPH, ITEM, TERM), "button": (PARAGRAPH,),
    "ul": (ITEM,), "ol": (ITEM,), "menu": (ITEM,), "dl": (TERM,), "tr": (CELL,), "select": (OPTION,), "foreignobject": (FOREIGN,),
}
#: What an opening tag of the key ends, the outermost first.
CLOSES = {"li": (ITEM,), "dt": (TERM,), "dd": (TERM,), "tr": (ROW, CELL), "td": (CELL,), "th": (CELL,), "option": (OPTION,)}
#: An end tag of another element does not reach beyond these.
CELLS = frozenset("td th caption".split())
TABLE = frozenset("table thead tbody tfoot tr td th caption html body".split())
ENDS_P = BLOCK - frozenset("br html body head title".split())
#: Names that the generated training pages give to their parts (fixed values).
TOKENS = (
    ("main", "article content main post entry story body text prose page markdown"),
    ("menu", "nav menu navbar breadcrumb breadcrumbs navigation toc tabs pagination pager links skip"),
    ("head", "header masthead banner topbar logo branding"),
    ("foot", "footer foot copyright legal colophon bottom"),
    ("side", "sidebar side aside widget widgets rail related recommended recommendations popular trending more teaser"),
    ("note", "cookie cookies notice consent gdpr alert popup modal overlay message newsletter subscribe signup paywall"),
    ("advert", "ad ads advert adverts advertisement sponsor sponsored promo promotion promoted"),
    ("form", "form search login contact input field"),
    ("talk", "comment comments reply replies discussion respond disqus thread responses reader"),
    ("share", "share social sharing follow tags meta byline author"),
)
TAGS = ("article main section div p h1 h2 h3 h4 h5 h6 ul ol li a nav header footer aside form table td blockquote pre xmp figure figcaption b i em strong span code label button").split()

_gap, _name, _equals, _bare = (re.compile(x) for x in (r"[\s/]*", r"=?[^\s/>=]*", r"\s*=\s*", r"[^\s>]*"))
_tag_name = re.compile(r"[a-zA-Z][^\s/>]*")
_raw_end = {tag: re.compile(rf"</{tag}(?=[\s/>]|$)", re.I) for tag in RAW}
_token = re.compile(r"[a-z]+")
_white = re.compile(r"\s+")
NAMED = frozenset("class id role aria-label itemprop".split())


class Node:
    __slots__ = ("attrs", "children", "depth", "parent", "scope", "tag")

    def __init__(self, tag: str, parent: Node | None, attrs: tuple[tuple[str, str], ...] = ()):
        self.tag, self.parent, self.attrs = tag, parent, attrs
        #: Elements and pieces of text, in order.
        self.children: list[Node | str] = []
        self.depth = parent.depth + 1 if parent else 0
        scope = parent.scope if parent else (None,) * 7
        if tag in KIND or tag in NEW_SCOPE:
            mine: list[Node | None] = list(scope)
            for kind in NEW_SCOPE.get(tag, ()):
                mine[kind] = None
            if tag in KIND:
                mine[KIND[tag]] = self
            scope = tuple(mine)
        #: The innermost open element of each kind, as this one's content sees it.
        self.scope = scope


def _attributes(page: str, at: int) -> tuple[list[tuple[str, str]], int, bool]:
    """The attributes from here on, where the tag ends (the end of the page if nowhere), and whether a slash ends it."""
    found: list[tuple[str, str]] = []
    n = len(page)
    while True:
        start, at = at, _gap.match(page, at).end()
        if at >= n:
            return found, n, False
        if page[at] == ">":
            return found, at + 1, page[at - 1] == "/" and at > start
        m = _name.match(page, at)
        at = m.end()
        equals = _equals.match(page, at)
        if not equals:
            found.append((m[0].lower(), ""))
            continue
        at = equals.end()
        quote = page[at : at + 1]
        if quote in ("'", '"'):
            end = page.find(quote, at + 1)
            if end < 0:  # there is no other such quote on the page, so this is looked for once
                end = page.find(">", at)
                return found, end + 1 if end >= 0 else n, False
            found.append((m[0].lower(), page[at + 1 : end]))
            at = end + 1
        else:
            value = _bare.match(page, at)
            found.append((m[0].lower(), value[0]))
            at = value.end()


class Builder:
    """The open elements while a page is read."""

    def __init__(self):
        self.root = self.here = Node("#root", None)
        #: How many elements of a tag are open, for each open table cell anew.
        self.open: list[dict[str, int]] = [{}]
        #: The same for the whole page, for the tags of tables, whose end tags reach out of cells.
        self.whole: Counter[str] = Counter()

    def text(self, piece: str) -> None:
        if piece:
            if self.here.tag == "head" and not piece.isspace():
                self.leave(self.here)
            self.here.children.append(entities.unescape(piece))

    def leave(self, node: Node) -> None:
        """Close an open element with all in it; each is closed once, so all closing is linear."""
        while True:
            closed, self.here = self.here, self.here.parent
            if closed.tag in CELLS:
                self.open.pop()
            self.open[-1][closed.tag] -= 1
            self.whole[closed.tag] -= 1
            if closed is node:
                return

    def start(self, tag: str, attrs: list[tuple[str, str]], closed: bool) -> None:
        if self.here.tag == "head" and tag not in HEAD:
            self.leave(self.here)
        if tag in ENDS_P and self.here.scope[PARAGRAPH]:
            self.leave(self.here.scope[PARAGRAPH])
        for kind in CLOSES.get(tag, ()):
            if self.here.scope[kind]:
                self.leave(self.here.scope[kind])
                break
        node = Node(tag, self.here, tuple(attrs))
        self.here.children.append(node)
        if tag in VOID or tag in RAW or (closed and node.scope[FOREIGN]):
            return
        self.open[-1][tag] = self.open[-1].get(tag, 0) + 1
        self.whole[tag] += 1
        if tag in CELLS:
            self.open.append({})
        self.here = node

    def end(self, tag: str) -> None:
        if not (self.whole[tag] if tag in TABLE else self.open[-1].get(tag)):
            return
        node = self.here
        while node.tag != tag:
            node = node.parent
        self.leave(node)


def parse(page: str) -> Node:
    """The tree of a page under an artificial root."""
    tree, at, n = Builder(), 0, len(page)
    text_from = 0
    while True:
        at = page.find("<", at)
        if at < 0:
            break
        m = _tag_name.match(page, at + 1)
        if m:
            tree.text(page[text_from:at])
            tag = m[0].lower()
            attrs, at, closed = _attributes(page, m.end())
            tree.start(tag, attrs, closed)
            if tag in RAW:
                end = _raw_end[tag].search(page, at)
                if tag == "xmp":
                    tree.here.children[-1].children.append(page[at : end.start() if end else n])
                stop = page.find(">", end.start()) if end else -1
                at = stop + 1 if stop >= 0 else n
        elif page.startswith("</", at):
            tree.text(page[text_from:at])
            m = _tag_name.match(page, at + 2)
            if m:
                _, at, _ = _attributes(page, m.end())
                tree.end(m[0].lower())
            else:
                at = page.find(">", at) + 1 or n
        elif page.startswith("<!--", at):
            tree.text(page[text_from:at])
            if page.startswith((">", "->"), at + 4):
                at = page.find(">", at) + 1
            else:
                at = page.find("-->", at + 4) + 3
                at = at if at > 2 else n
        elif page.startswith(("<!", "<?"), at):
            tree.text(page[text_from:at])
            at = page.find(">", at) + 1 or n
        else:  # a bare sign
            at += 1
            continue
        text_from = at
    tree.text(page[text_from:])
    return tree.root


def elements(root: Node) -> list[Node]:
    """All elements in page order, parents before children; the root is the first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return out


def names(node: Node) -> set[str]:
    """The words of an element's attributes that name it."""
    return {w for name, value in node.attrs if name in NAMED for w in _token.findall(value.lower())}


def features(nodes: list[Node], codes: dict[str, float]) -> np.ndarray:
    """A row per element: subtree density, attribute tokens, depth, siblings."""
    n = len(nodes)
    place = {id(x): i for i, x in enumerate(nodes)}
    parent = np.array([place[id(x.parent)] if x.parent else -1 for x in nodes])
    own = np.zeros((n, 6))  # characters, words, link characters, stops, blocks, elements
    kinds = np.zeros((n, 4))  # of the names' codes: least, greatest, sum; how many are known
    tags = np.zeros((n, len(TAGS)))
    tag_at = {t: k for k, t in enumerate(TAGS)}
    in_link = np.zeros(n, dtype=bool)
    hidden = np.zeros(n, dtype=bool)
    for i, x in enumerate(nodes):
        up = parent[i]
        in_link[i] = x.tag == "a" or (up >= 0 and in_link[up])
        hidden[i] = x.tag in HIDDEN or (up >= 0 and hidden[up])
        if not hidden[i]:
            text = " ".join(c for c in x.children if isinstance(c, str)).strip()
            own[i, :4] = len(text), text.count(" ") + bool(text), len(text) * in_link[i], sum(text.count(c) for c in ".,!?;")
        own[i, 4:] = x.tag in BLOCK, 1
        if x.tag in tag_at:
            tags[i, tag_at[x.tag]] = 1
        if x.attrs and (known := [codes[w] for w in names(x) if w in codes]):
            kinds[i] = min(0, *known), max(0, *known), sum(known), len(known)
    total = own.copy()
    for i in range(n - 1, 0, -1):
        total[parent[i]] += total[i]
    above = np.zeros((n, 2))
    for i in range(1, n):
        up = parent[i]
        above[i] = min(above[up, 0], kinds[up, 0]), max(above[up, 1], kinds[up, 1])
    count = np.bincount(parent[1:], minlength=n) if n > 1 else np.zeros(n)
    order = np.zeros(n)
    seen = np.zeros(n)
    for i in range(1, n):
        order[i] = seen[parent[i]]
        seen[parent[i]] += 1
    up = np.maximum(parent, 0)
    page = np.maximum(total[0], 1)
    chars, elements_, links = total[:, 0], total[:, 5], total[:, 2]
    siblings = np.maximum(count[up] - 1, 0)
    tag_names = [x.tag for x in nodes]
    same = np.array([0.0 if p < 0 else 1.0 for p in parent])
    of_parent: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        of_parent[(parent[i], tag_names[i])] = of_parent.get((parent[i], tag_names[i]), 0) + 1
    same[1:] = [of_parent[(parent[i], tag_names[i])] for i in range(1, n)]
    beside = np.maximum(chars[up] - chars, 0) / np.maximum(siblings, 1)
    flags = {name: np.array([t == name for t in tag_names]) for name in ("nav", "header", "footer", "aside", "form", "main", "article", "details")}
    inside = np.zeros((n, len(flags)))
    for k, name in enumerate(flags):
        for i in range(1, n):
            inside[i, k] = inside[parent[i], k] + flags[name][parent[i]]
    base = np.stack([
        np.log1p(own[:, 0]), np.log1p(chars), np.log1p(total[:, 1]), chars / np.maximum(elements_, 1),
        links / np.maximum(chars, 1), total[:, 3] / np.maximum(total[:, 1], 1), total[:, 4] / np.maximum(elements_, 1),
        chars / page[0], np.log1p(elements_), np.array([x.depth for x in nodes], dtype=float),
        np.log1p(siblings), order / np.maximum(siblings, 1), order, np.log1p(same),
        np.log1p(beside), np.log1p(chars[up]), links[up] / np.maximum(chars[up], 1), chars / np.maximum(chars[up], 1),
        hidden.astype(float),
        *inside.T,
        # whether the page has a main element or articles, and how much of it an element of a form holds
        np.full(n, float(flags["main"].any())), np.minimum(np.full(n, float(flags["article"].sum())), 3), np.where(flags["form"], chars / page[0], 0) + np.where(flags["form"], elements_ / total[0, 5], 0),
        *_kin(parent, tag_names, chars),
    ], axis=1)
    return np.concatenate([base, kinds, above, tags], axis=1)


def _kin(parent: np.ndarray, tags: list[str], chars: np.ndarray) -> list[np.ndarray]:
    """Per element: how many siblings have the same tag and begin with the same child, and the characters of text beside links among its parent's children."""
    n = len(tags)
    first = [""] * n
    for i in range(n - 1, 0, -1):
        first[parent[i]] = tags[i]
    alike: dict[tuple[int, str, str], int] = {}
    heads = np.zeros(n)
    prose = np.zeros(n)
    for i in range(1, n):
        key = (int(parent[i]), tags[i], first[i])
        alike[key] = alike.get(key, 0) + 1
        heads[parent[i]] += tags[i] in ("h1", "h2", "h3")
        prose[parent[i]] += chars[i] if tags[i] in ("p", "pre", "blockquote") else 0
    up = np.maximum(parent, 0)
    same = np.array([0.0] + [alike[(int(parent[i]), tags[i], first[i])] for i in range(1, n)])
    return [np.log1p(same), heads[up], np.log1p(prose), np.log1p(prose[up])]


class Trees:
    """Boosted regression trees for a yes or no, over binned features."""

    #: How often names stand at main text, as log odds.
    codes: dict[str, float]

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS):
        self.trees, self.depth, self.rate, self.bins = trees, depth, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [self._cuts(c) for c in x.T]
        binned = self._binned(x)
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.first = float(np.log(mean / (1 - mean)))
        score, self.nodes = np.full(len(y), self.first), []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            tree = self._tree(binned, y - p, p * (1 - p))
            self.nodes.append(tree)
            score += self._leaf(tree, binned)
        return self

    def _cuts(self, column: np.ndarray) -> np.ndarray:
        """Between values: half at quantiles of the rows, half at those of the distinct values, so that rare ones are told apart too."""
        values = np.unique(column)
        if len(values) <= self.bins:
            return (values[1:] + values[:-1]) / 2
        steps = np.linspace(0, 1, self.bins // 2 + 1)[1:-1]
        at = np.unique(np.searchsorted(values, np.concatenate([np.quantile(column, steps), np.quantile(values, steps)])))
        at = at[(at > 0) & (at < len(values))]
        return (values[at] + values[at - 1]) / 2

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="right") for c, v in zip(self.cuts, x.T)], axis=1).astype(np.int64)

    def _tree(self, b: np.ndarray, g: np.ndarray, h: np.ndarray):
        """Arrays of a complete tree: feature and cut of the inner nodes, values of the leaves."""
        n, f = b.shape
        feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, self.bins, np.int64)
        at = np.zeros(n, np.int64)
        keys = b + np.arange(f) * self.bins
        for level in range(self.depth):
            width = 2**level
            for node in range(width):
                rows = np.flatnonzero(at == node)
                if len(rows) < 8:
                    continue
                k = keys[rows].ravel()
                gs = np.bincount(k, np.repeat(g[rows], f), f * self.bins).reshape(f, -1).cumsum(axis=1)
                hs = np.bincount(k, np.repeat(h[rows], f), f * self.bins).reshape(f, -1).cumsum(axis=1)
                total_g, total_h = gs[0, -1], hs[0, -1]
                gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
                best = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[best] > 1e-6:
                    feature[width - 1 + node], cut[width - 1 + node] = best
            inner = width - 1 + at
            at = 2 * at + (b[np.arange(n), feature[inner]] > cut[inner])
        leaves = 2**self.depth
        value = self.rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + 1)
        return feature, cut, value

    def _leaf(self, tree, b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        at, rows = np.zeros(len(b), np.int64), np.arange(len(b))
        for level in range(self.depth):
            inner = 2**level - 1 + at
            at = 2 * at + (b[rows, feature[inner]] > cut[inner])
        return value[at]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of yes."""
        b = self._binned(x)
        return self.first + sum((self._leaf(t, b) for t in self.nodes), np.zeros(len(x)))


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """The most likely choice in which main elements form a tree from the root."""
    place = {id(x): i for i, x in enumerate(nodes)}
    parent = [place[id(x.parent)] if x.parent else -1 for x in nodes]
    yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    none, some = no.copy(), yes.copy()  # the best of each subtree without and with its top
    for i in range(len(nodes) - 1, 0, -1):
        none[parent[i]] += none[i]
        some[parent[i]] += max(none[i], some[i])
    keep = np.zeros(len(nodes), dtype=bool)
    keep[0] = True
    for i in range(1, len(nodes)):
        keep[i] = keep[parent[i]] and some[i] > none[i] and nodes[i].tag not in HIDDEN
    return keep


def blocks(root: Node, kept: set[int]) -> list[str]:
    """The blocks of the kept elements in page order."""
    out: list[str] = []
    current: list[str] = []

    def flush() -> None:
        text = _white.sub(" ", "".join(current)).strip()
        if text:
            out.append(text)
        current.clear()

    stack: list[tuple[Node | str, bool]] = [(root, False)]
    while stack:
        node, closing = stack.pop()
        if isinstance(node, str):
            current.append(node)
            continue
        block = node.tag in BLOCK
        if block:
            flush()
        if closing or id(node) not in kept:
            continue
        if block:
            stack.append((node, True))
        stack.extend((c, False) for c in reversed(node.children))
    flush()
    return out


def main_text(pages: list[str | None], model: Trees) -> list[str]:
    """The main text of each page."""
    trees = [elements(parse(p or "")) for p in pages]
    rows = [features(t, model.codes) for t in trees]
    odds = model.score(np.concatenate(rows)) if rows else np.empty(0)
    # a formula or drawing is one thing: what is in it goes where it goes
    odds[[node.parent is not None and node.parent.scope[FOREIGN] is not None for t in trees for node in t]] = 10.0
    out, at = [], 0
    for nodes, x in zip(trees, rows):
        keep = decode(nodes, odds[at : at + len(x)])
        at += len(x)
        out.append("\n".join(blocks(nodes[0], {id(node) for node, k in zip(nodes, keep) if k})))
    return out


class Maker:
    """Generated pages with labelled nodes: an attribute ``data-y`` marks main elements."""

    def __init__(self, seed: int = SEED):
        self.r = random.Random(seed)
        alphabet = [a + b for a in "b c d f g l m n p r s t v th st tr".split() for b in "a e i o u é".split()]
        self.lexicon = ["".join(self.r.choices(alphabet, k=self.r.choice((1, 1, 2, 2, 3, 4)))) for _ in range(3000)]

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.r.choices(self.lexicon, k=self.r.randint(lo, hi)))

    def sentences(self, lo: int, hi: int) -> str:
        marks = self.r.random() < 0.9
        return " ".join(self.words(4, 18).capitalize() + ("." if marks else "") for _ in range(self.r.randint(lo, hi)))

    def named(self, kind: int) -> str:
        word = self.r.choice(TOKENS[kind][1].split())
        how = self.r.random()
        return f' class="{word}"' if how < 0.5 else f' id="{word}"' if how < 0.7 else f' class="{self.r.choice(["box", "site", "c1", "block"])} {word}-{self.r.choice(["wrap", "inner", "list", "area"])}"'

    def odd(self) -> str:
        """A name that says nothing."""
        return "-".join("".join(self.r.choices("abcdefghjkmnqrstuvwxyz", k=self.r.randint(1, 6))) for _ in range(2))

    def links(self, lo: int, hi: int) -> str:
        items = [f'<a href="/{w}">{w}</a>' for w in (self.words(1, 3) for _ in range(self.r.randint(lo, hi)))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.r.random() < 0.75 else " ".join(items)

    def clutter(self, inside: bool = False) -> str:
        """One part that is not main text."""
        r = self.r
        kind = r.choice(("nav", "head", "foot", "side", "note", "advert", "advert", "form", "talk", "share", *(() if inside else ("foot", "plain"))))
        say = self.sentences(1, 2) if r.random() < 0.7 else self.words(2, 9)
        box = r.choice(("div", "section", "div"))
        if kind == "plain":  # nothing but its name or its place tells
            return r.choice((f"<noscript><p>{self.words(3, 9)}.</p></noscript>", f"<noscript>{self.words(3, 9)}</noscript>", f"<div class='{self.odd()}'>{self.links(2, 6)}</div>", f"<button>{self.words(1, 2)}</button>", f"<p><a href=/x>{self.words(1, 4)}</a></p>"))
        if kind == "nav":
            return f"<nav>{self.links(2, 9)}</nav>" if r.random() < 0.6 else f"<div{self.named(1)}>{self.links(2, 9)}</div>"
        if kind == "head":
            inner = f"<h1><a href='/'>{self.words(1, 3)}</a></h1><p>{self.words(2, 8)}</p>" if r.random() < 0.5 else f"<p>{say}</p>" + self.links(1, 4)
            return f"<header>{inner}</header>" if r.random() < 0.7 else f"<div{self.named(2)}>{inner}</div>"
        if kind == "foot":
            say = f"&copy; {self.words(1, 2)} &middot; {say}" if r.random() < 0.5 else say
            inner = r.choice((say, say, f"<p>{say}</p>", self.links(2, 6), f"<p>{say}</p>{self.links(1, 5)}"))
            return f"<footer>{inner}</footer>" if r.random() < 0.7 else f"<div{self.named(3)}>{inner}</div>"
        if kind == "side":
            inner = f"<h3>{self.words(1, 3)}</h3>" + r.choice((self.links(2, 8), f"<p>{self.sentences(1, 4)}</p>"))
            return f"<aside{r.choice(['', self.named(4)])}>{inner}</aside>" if r.random() < 0.6 else f"<{box}{self.named(4)}>{inner}</{box}>"
        if kind == "note":
            inner = r.choice((f"<p>{say}</p><button>{self.words(1, 2)}</button>", say))
            return f"<{box}{self.named(5)}>{inner}</{box}>"
        if kind == "advert":
            return f"<{box}{self.named(6)}>{r.choice((say, f'<p>{say}</p>', f'<a href=x>{say}</a>'))}</{box}>"
        if kind == "form":
            inner = f"<label>{self.words(1, 3)}</label><input name=q>" + r.choice(("", f"<p>{say}</p>", f"<select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select>"))
            return f"<form action=/s>{inner}<button>{self.words(1, 2)}</button></form>" if r.random() < 0.8 else f"<div{self.named(7)}>{inner}</div>"
        if kind == "talk":
            one = lambda: f"<{r.choice(['li', 'div', 'article'])}{self.named(8)}><b>{self.words(1, 2)}</b><p>{self.sentences(1, 4)}</p>"
            items = "".join(x + f"</{re.match(r'<(.+?)[ >]', x)[1]}>" for x in (one() for _ in range(r.randint(1, 6))))
            return f"<{box}{self.named(8)}><h3>{self.words(1, 2)}</h3>{items}</{box}>"
        return f"<div{self.named(9)}>{self.links(1, 5)}</div>"

    def strangers(self) -> str:
        """Readers' comments or a side column that no name tells, as they stand beside the main text."""
        r, name = self.r, self.odd()
        if r.random() < 0.3:
            return f"<div class='{name}'><h3>{self.words(1, 3)}</h3>{self.links(2, 6)}</div>"
        tag = r.choice(("h4", "b", "h5", "strong"))
        items = "".join(f"<div class='{name}'><{tag}>{self.words(1, 2)}</{tag}><p>{self.sentences(1, 3)}</p></div>" for _ in range(r.randint(1, 6)))
        return items if r.random() < 0.5 else f"<div class='{self.odd()}'>{items}</div>"

    def listed(self) -> str:
        """A list of the main text whose items are links, with or without more."""
        r = self.r
        item = r.choice((lambda: f"<a href=/{self.words(1, 1)}>{self.words(1, 9)}</a>", lambda: f"<a href=/x>{self.words(1, 5)}</a> {self.words(2, 12)}.", lambda: f"{self.words(1, 5)} <a href=/x>{self.words(1, 6)}</a>"))
        kind = r.choice(("ul", "ul", "ol"))
        before = r.choice(("", f"<h{r.randint(2, 3)}>{self.words(1, 3)}</h2>", f"<p>{self.sentences(1, 2)}</p>"))
        return before + f"<{kind}>" + "".join(f"<li>{item()}</li>" for _ in range(r.randint(2, 8))) + f"</{kind}>"

    def folded(self) -> str:
        return f"<details><summary>{self.words(1, 6)}</summary>" + "".join(f"<p>{self.sentences(1, 3)}</p>" for _ in range(self.r.choice((1, 1, 2)))) + "</details>"

    def parted(self) -> str:
        """Sections of the main text, short ones too."""
        return "".join(f"<section><h2>{self.words(1, 4)}</h2><p>{self.sentences(1, 2)}</p>{self.r.choice(('', f'<pre>{self.words(1, 5)}</pre>', f'<p>{self.words(2, 8)}.</p>'))}</section>" for _ in range(self.r.randint(1, 4)))

    def marked(self, markup: str) -> str:
        """The markup with every element of it marked as main."""
        return re.sub(r"<([a-z][a-z0-9]*)", r"<\1 data-y", markup)

    def body(self) -> str:
        r = self.r
        rich = lambda s: re.sub(r"(\S+)$", r.choice((r"<b>\1</b>", r'<a href="/x">\1</a>', r"<em>\1</em>", r"\1")), s)
        parts = []
        for _ in range(r.choice((1, 1, 1, 2, 2, 3, 4, 6, 9, 14))):
            kind = r.random()
            if r.random() < 0.1:
                parts.append(self.marked(r.choice((self.listed, self.listed, self.folded, self.parted))()))
            elif kind < 0.72:
                p = self.sentences(1, 30 if r.random() < 0.2 else 7) if r.random() < 0.75 else self.words(1, 6)
                parts.append(self.marked(f"<p>{rich(p)}</p>" if r.random() < 0.7 else f"<p>{p}" if r.random() < 0.5 else f"<p><b>{p}<br>"))
            elif kind < 0.8:
                parts.append(self.marked(f"<h{r.randint(2, 4)}>{self.words(1, 6)}</h2>"))
            elif kind < 0.86:
                parts.append(self.marked("<ul>" + "".join(f"<li>{self.words(2, 20)}</li>" for _ in range(r.randint(2, 6))) + "</ul>"))
            elif kind < 0.9:
                parts.append(self.marked(f"<blockquote><p>{self.sentences(1, 3)}</p></blockquote>"))
            elif kind < 0.93:
                parts.append(self.marked("<table>" + "".join(f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>"))
            elif kind < 0.97:
                w = self.words
                parts.append(self.marked(r.choice((f"<p>{w(4, 9)} <math><mi>{w(1, 1)}</mi><mo>=</mo><mn>2</mn></math> {w(2, 9)}.</p>", *[f"<noscript><p>{self.sentences(1, 3)}</p></noscript>", f"<noscript>{self.sentences(1, 2)}</noscript>"] * 3, f"<figure><img src=x><figcaption>{w(3, 12)}</figcaption></figure>", f"<object><p>{w(4, 14)}</p></object>", f"<p>{w(3, 9)} <button>{w(1, 2)}</button> {w(3, 9)}</p>", f"<pre><code>{w(3, 20)}</code></pre>", f"<dl><dt>{w(1, 3)}<dd>{w(4, 14)}<dt>{w(1, 3)}<dd>{w(4, 14)}</dl>", f"<details><summary>{w(1, 4)}</summary><p>{self.sentences(1, 3)}</p></details>", f"<div class='{self.odd()}'><p>{self.sentences(1, 4)}</p></div>"))))
            else:
                parts.append(self.clutter(inside=True))
        return "".join(parts)

    def page(self) -> str:
        """A page; one in ten leaves out the tags that may be."""
        whole = self.whole_page()
        return re.sub(r"</?(?:html|body)[^>]*>", "", whole) if self.r.random() < 0.1 else whole

    def whole_page(self) -> str:
        r = self.r
        title = self.words(1, 14) if r.random() < 0.8 else self.sentences(1, 2)
        body = self.marked(f"<h1>{title}</h1>") * (r.random() < 0.9)
        body += self.body() if r.random() < 0.85 else self.marked(r.choice((f"<p>{self.words(1, 8)}</p>", f"<p><b>{title}<br></p>", f"<p>{self.words(2, 9)}")))
        how = r.random()
        if how < 0.03:  # no main text at all
            return "<html data-y><body data-y>" + "".join(self.clutter() for _ in range(r.choice((1, 1, 2, 4)))) + "</body></html>"
        if how < 0.15:  # no wrapper: the text stands in the body, now and then with nothing around it
            body = r.choice((body, self.marked(f"<p>{self.sentences(1, 6)}</p>"), self.sentences(1, 6), self.marked(f"<h1>{title}</h1><p>{self.words(3, 30)}</p>")))
            return f"<html data-y><head><title>{title}</title></head><body data-y>{self.clutter() * (r.random() < 0.4)}{body}{self.clutter() * (r.random() < 0.4)}</body></html>"
        if how < 0.55:
            main = f"<article data-y{r.choice(['', '', self.named(0)])}>{body}</article>"
        elif how < 0.7:
            main = f"<main data-y{r.choice(['', self.named(0)])}>{body}</main>"
        elif how < 0.78:
            main = f"<div data-y class='{self.odd()}'>{body}</div>"
        else:
            main = f"<{(t := r.choice(['div', 'div', 'section']))} data-y{self.named(0)}>{body}</{t}>"
        for _ in range(r.choice((0, 0, 1, 2))):
            main = f"<{(t := r.choice(['div', 'main', 'div']))} data-y{r.choice(['', self.named(0)])}>{self.clutter() * (r.random() < 0.3)}{main}{self.clutter() * (r.random() < 0.4)}</{t}>"
        before = "".join(self.clutter() for _ in range(r.choice((0, 1, 2, 3, 4))))
        after = "".join(self.clutter() for _ in range(r.choice((0, 1, 1, 2, 4))))
        if how < 0.7 and r.random() < 0.25:
            after = self.strangers() + after
        end = "</body></html>" if r.random() < 0.9 else ""
        inner = f"{before}<!-- {self.words(1, 3)} -->{main}{after}"
        if r.random() < 0.08:  # a form around the whole page
            inner = f"<form data-y method=post action=/{self.words(1, 1)}><input type=hidden name=s value={self.words(1, 1)}>{inner}</form>"
        return f"<!DOCTYPE html><html data-y><head><title>{title}</title><style>p{{}}</style></head><body data-y>{inner}{end}"


def is_main(node: Node) -> float:
    return float(node.tag == "#root" or any(name == "data-y" for name, _ in node.attrs))


def counted(trees: list[list[Node]]) -> dict[str, float]:
    """For each name its log odds to stand at main text; two elements that say nothing are added to both sides."""
    yes: dict[str, list[float]] = {}
    for nodes in trees:
        for node in nodes:
            for w in names(node):
                both = yes.setdefault(w, [2.0, 2.0])
                both[is_main(node) > 0] += 1
    return {w: float(np.log(b / a)) for w, (a, b) in yes.items() if a + b > 8}


def labelled(pages: int = TRAIN_PAGES, seed: int = SEED, codes: dict[str, float] | None = None) -> tuple[np.ndarray, np.ndarray, dict[str, float]]:
    """Features and labels of the elements of generated pages, and the codes of names, counted on as many others."""
    maker = Maker(seed)
    if codes is None:
        codes = counted([elements(parse(maker.page())) for _ in range(pages)])
    trees = [elements(parse(maker.page())) for _ in range(pages)]
    return np.concatenate([features(t, codes) for t in trees]), np.array([is_main(node) for t in trees for node in t]), codes


@functools.cache
def fitted(pages: int = TRAIN_PAGES, seed: int = SEED) -> Trees:
    """The model, fitted once in a process."""
    x, y, codes = labelled(pages, seed)
    model = Trees().fit(x, y)
    model.codes = codes
    return model


def extract(pages: DataFrame, model: Trees | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    trees = model or fitted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                texts = main_text(part.column("html").to_pylist(), trees)
                yield pa.record_batch([part.column("page_id").cast(pa.int64()), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
