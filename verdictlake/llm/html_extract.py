"""Main-text extraction: gradient-boosted trees over DOM-node features, decoded along the tree.

A page becomes a tree of block elements; text that stands beside blocks becomes a block of its
own. Boosted trees give each node the probabilities that its subtree is all text to keep, all to
drop, or a mixture. The decoding maximises their product over the whole tree under the rule that
everything below a kept node is kept and everything below a dropped one is dropped, so that
ancestors and descendants never contradict each other.

The trees are learned here, on the driver, from pages of a seeded generator whose every node has
a known label (TRAIN_PAGES of them, the documented bound); no row of the input is used to fit.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_batches

#: Generated pages to learn from, boosting rounds, depth of a tree, shrinkage.
TRAIN_PAGES, ROUNDS, DEPTH, RATE = 500, 24, 4, 0.3

KEEP, DROP, MIXED = 0, 1, 2

# Elements of the HTML standard by how they are parsed and shown.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
#: Their content is no markup: it goes on to their own end tag (of the first two without one, to the end of the page).
RAW = frozenset("script style title textarea iframe".split())
#: Elements whose content isn't shown as text; of the second set a block ends one that was left open.
UNSEEN = frozenset("noscript template svg canvas select audio video".split())
ENDED_BY_BLOCKS = UNSEEN - {"noscript", "template"}
#: A start tag of the key ends an open element of the first set, if none of the second set is nearer.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
#: Words of class, id and role attributes, by what they usually name; those of the last group name parts of articles as often as parts around them.
TOKEN_GROUPS = (
    frozenset("article content main post entry story body text prose page paragraph blog".split()),
    frozenset("nav navigation navbar menu breadcrumb breadcrumbs pagination pager tabs toc skip".split()),
    frozenset("header masthead banner logo topbar branding".split()),
    frozenset("footer foot copyright colophon contentinfo".split()),
    frozenset("sidebar aside complementary rail widget widgets recommended recommendations trending".split()),
    frozenset("ad ads adv advert advertisement advertising sponsor sponsored promo dfp adsense".split()),
    frozenset("cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription paywall signup dialog".split()),
    frozenset("comment comments commentlist reply replies respond disqus reactions".split()),
    frozenset("form login signin register input".split()),
    frozenset("social sharing facebook twitter follow icons buttons toolbar".split()),
    frozenset("related notice notices legal discussion responses feedback contact search share popular more tags privacy print side top bottom promotion field".split()),
)

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""")
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    attributes: str = ""
    children: list = field(default_factory=list)
    text: str = ""  # of a leaf
    links: int = 0  # characters of a leaf that stand in links
    label: str = ""  # of generated pages only


class _Ends:
    """Where the next end tag of a name starts, found without looking at any part of a page twice."""

    def __init__(self, html: str) -> None:
        self.html = html.lower()
        if len(self.html) != len(html):  # a few letters grow in small case; end tags are ASCII
            self.html = "".join(c.lower() if c < "\x80" else c for c in html)
        self.known: dict[str, int] = {}

    def after(self, tag: str, at: int) -> int:
        """-1 if there is none."""
        found = self.known.get(tag, 0)
        if 0 <= found < at:
            found = self.html.find(f"</{tag}", at)
            self.known[tag] = found
        elif tag not in self.known:
            self.known[tag] = found = self.html.find(f"</{tag}", at)
        return found


class _Builder:
    """The tree under construction; every step takes constant time beside what it closes."""

    def __init__(self) -> None:
        self.nodes = [Node("html", -1, 0)]
        self.stack: list[tuple[str, int]] = [("html", 0)]  # every open element and the block it belongs to
        self.frames = [0]  # places of the open blocks in the stack
        self.inline: list[dict[str, int]] = [{}]  # for each open block, how many elements of a name are open right in it
        self.blocks: dict[str, list[int]] = {}  # places of the open blocks of a name
        self.run: list[str] = []
        self.linked = self.in_link = self.unseen = 0

    def text(self, piece: str) -> None:
        if not self.unseen:
            self.run.append(piece)
            if self.in_link:
                self.linked += len(piece)

    def flush(self) -> None:
        if self.run:
            text = " ".join(unescape("".join(self.run)).split())
            if text:
                owner = self.stack[-1][1]
                self.nodes[owner].children.append(len(self.nodes))
                self.nodes.append(Node("#text", owner, self.nodes[owner].depth + 1, "", [], text, min(self.linked, len(text))))
            self.run.clear()
            self.linked = 0

    def open(self, tag: str, attributes: str) -> None:
        owner = self.stack[-1][1]
        if tag in BLOCKS:
            self.flush()
            self.nodes[owner].children.append(len(self.nodes))
            self.nodes.append(Node(tag, owner, self.nodes[owner].depth + 1, attributes))
            owner = len(self.nodes) - 1
            self.blocks.setdefault(tag, []).append(len(self.stack))
            self.frames.append(len(self.stack))
            self.inline.append({})
        else:
            self.inline[-1][tag] = self.inline[-1].get(tag, 0) + 1
            self.in_link += tag == "a"
            self.unseen += tag in UNSEEN
        self.stack.append((tag, owner))

    def pop(self) -> None:
        tag = self.stack[-1][0]
        if tag in BLOCKS:
            self.flush()
            self.frames.pop()
            self.inline.pop()
            self.blocks[tag].pop()
        else:
            self.inline[-1][tag] -= 1
            self.in_link -= tag == "a"
            self.unseen -= tag in UNSEEN
        self.stack.pop()

    def pop_to(self, place: int) -> None:
        while len(self.stack) > place:
            self.pop()

    def close(self, tag: str) -> None:
        """An inline element isn't closed beyond its block; an end tag without its element is ignored."""
        if tag in BLOCKS:
            if self.blocks.get(tag):
                self.pop_to(self.blocks[tag][-1])
        elif self.inline[-1].get(tag):
            while self.stack[-1][0] != tag:
                self.pop()
            self.pop()

    def make_room(self, tag: str) -> None:
        """Ends what a block's start tag ends."""
        while self.unseen and self.stack[-1][0] not in BLOCKS and any(self.inline[-1].get(x) for x in ENDED_BY_BLOCKS):
            self.pop()
        self.flush()
        if tag in CLOSES_P and len(self.frames) > 1 and self.stack[self.frames[-1]][0] == "p":
            self.pop_to(self.frames[-1])
        if tag in IMPLIED:
            ends, within = IMPLIED[tag]
            wall = max((self.blocks[t][-1] for t in within if self.blocks.get(t)), default=0)
            over = [places[k] for t in ends if (places := self.blocks.get(t)) and (k := bisect_right(places, wall)) < len(places)]
            if over:
                self.pop_to(min(over))


def parse(html: str) -> list[Node]:
    """The block elements and text runs of a page in page order, the root first; attributes stay as written."""
    tree, ends, at, size = _Builder(), _Ends(html), 0, len(html)
    while at < size:
        start = html.find("<", at)
        if start < 0:
            break
        if start > at:
            tree.text(html[at:start])
        mark = html[start + 1 : start + 2]
        if mark in ("!", "?"):
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                at = size if end < 0 else end + 3
            else:
                end = html.find(">", start)
                at = size if end < 0 else end + 1
            continue
        m = _TAG.match(html, start)
        if not m:
            tree.text("<")
            at = start + 1
            continue
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        tag = tag.lower()
        if closing:
            tree.close(tag)
        elif tag == "br":
            tree.text(" ")
        elif tag in ("html", "head", "body"):
            if tag == "body":
                tree.flush()
                tree.nodes[0].attributes = tree.nodes[0].attributes or attributes
        elif tag in RAW:
            end = ends.after(tag, at)
            if end >= 0:
                at = html.find(">", end) + 1 or size
            elif tag in ("script", "style"):
                at = size
            else:  # left open: as far as its text goes
                end = html.find("<", at)
                at = size if end < 0 else end
        else:
            if tag in BLOCKS:
                tree.make_room(tag)
            elif tag in UNSEEN and ends.after(tag, at) < 0:
                continue
            if not (tag in VOID or attributes.rstrip().endswith("/") and tag not in BLOCKS):
                tree.open(tag, attributes)
    if at < size:
        tree.text(html[at:])
    tree.flush()
    return tree.nodes


_TAGS = sorted(BLOCKS | {"#text"})
_TAG_GROUP = {
    t: g
    for g, tags in enumerate(
        ("#text", "p blockquote pre", "h1", "h2 h3 h4 h5 h6 hgroup", "div section center", "article main", "nav menu", "header", "footer address", "aside", "form fieldset legend search dialog", "ul ol dl dir", "li dt dd", "table tbody thead tfoot tr td th caption", "figure figcaption details summary", "html body hr")
    )
    for t in tags.split()
}
_GROUPS = len(TOKEN_GROUPS)


def _tokens(attributes: str) -> set[str]:
    if not attributes:
        return set()
    found = set()
    for m in _NAMED.finditer(attributes):
        found.update(w.lower() for w in _WORD.findall(unescape(m[1] or m[2] or m[3] or "")))
    return found


def features(nodes: list[Node]) -> np.ndarray:
    """A row of features for each node: its tag and attribute words, those above it, subtree sizes and densities, depth, siblings."""
    n = len(nodes)
    own, above = np.zeros((n, _GROUPS), np.float32), np.zeros((n, _GROUPS), np.float32)
    group, depth = np.zeros(n), np.zeros(n)
    chars, links, marks, size, leaves, paragraphs, items = (np.zeros(n) for _ in range(7))
    hidden, tags_above = np.zeros(n), np.zeros((n, 6))
    place, siblings, before = np.zeros(n), np.ones(n), np.zeros(n)
    seen = 0.0
    for i, x in enumerate(nodes):
        group[i], depth[i] = _TAG_GROUP[x.tag], x.depth
        if x.parent >= 0:
            p = x.parent
            above[i] = np.maximum(above[p], own[p])
            tags_above[i] = tags_above[p]
            if 5 <= (g := int(group[p])) <= 10:
                tags_above[i, g - 5] = 1
            hidden[i] = hidden[p]
        if x.attributes:
            words = _tokens(x.attributes)
            if words:
                own[i] = [not words.isdisjoint(g) for g in TOKEN_GROUPS]
            if _HIDDEN.search(x.attributes):
                hidden[i] = 1
        before[i] = seen
        if x.tag == "#text":
            chars[i], links[i], leaves[i] = len(x.text), x.links, 1
            marks[i] = x.text.count(".") + x.text.count(",")
            seen += len(x.text)
        paragraphs[i], items[i], size[i] = x.tag == "p", x.tag == "li", 1
        for k, c in enumerate(x.children):
            place[c], siblings[c] = k, len(x.children)
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        for a in (chars, links, marks, size, leaves, paragraphs, items):
            a[p] += a[i]
    total = max(1.0, chars[0])
    parent = np.array([max(0, x.parent) for x in nodes])
    earlier, later = np.zeros(n), np.zeros(n)  # characters of the siblings beside a node
    for x in nodes:
        for a, b in zip(x.children, x.children[1:]):
            earlier[b], later[a] = chars[a], chars[b]
    columns = [
        group, group[parent], depth, np.log1p(chars), links / np.maximum(1, chars), marks / np.maximum(1, chars), chars / size, chars / np.maximum(1, leaves),
        chars / total, chars / np.maximum(1, chars[parent]), before / total, (before + chars) / total, size, leaves, paragraphs, items, place, siblings,
        place / siblings, np.log1p(earlier), np.log1p(later), links[parent] / np.maximum(1, chars[parent]), np.full(n, np.log1p(total)), hidden,
    ]
    return np.column_stack([*columns, *tags_above.T, *own.T, *above.T]).astype(np.float32)


@dataclass(frozen=True)
class Boosted:
    """Trees of full depth as arrays (tree, node): the feature, the threshold, and the leaves' values; a class takes every third tree."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        raw, rows = np.zeros((len(x), 3)), np.arange(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, self.feature[t, at]] > self.threshold[t, at])
            raw[:, t % 3] += self.value[t, at - (1 << DEPTH) + 1]
        raw -= raw.max(1, keepdims=True)
        p = np.exp(raw)
        return p / p.sum(1, keepdims=True)


def boost(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, bins: int = 32) -> Boosted:
    """Multi-class gradient boosting with second-order gains over histogram bins."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.column_stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(width)])
    flat = (binned + np.arange(width) * bins).astype(np.int64)
    inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
    features_, thresholds, values = [], [], []
    raw = np.zeros((n, 3))
    for _ in range(rounds):
        p = np.exp(raw - raw.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for k in range(3):
            g, h = p[:, k] - (y == k), np.maximum(p[:, k] * (1 - p[:, k]), 1e-6)
            at = np.zeros(n, np.int64)
            feature, threshold, bin_ = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, bins)
            for level in range(DEPTH):
                first, count = (1 << level) - 1, 1 << level
                cell = ((at - first)[:, None] * (width * bins) + flat).ravel()
                shape = (count, width, bins)
                gs = np.bincount(cell, np.repeat(g, width), count * width * bins).reshape(shape).cumsum(2)
                hs = np.bincount(cell, np.repeat(h, width), count * width * bins).reshape(shape).cumsum(2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < 1) | (ht - hs < 1)] = 0
                best = gain.reshape(count, -1).argmax(1)
                for j, b in enumerate(best):
                    f, c = divmod(int(b), bins)
                    if gain[j, f, c] > 1e-6 and c < len(cuts[f]):
                        feature[first + j], threshold[first + j], bin_[first + j] = f, cuts[f][c], c
                at = 2 * at + 1 + (binned[np.arange(n), feature[at]] > bin_[at])
            leaf = at - inner
            value = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + 1)
            raw[:, k] += value[leaf]
            features_.append(feature), thresholds.append(threshold), values.append(value)
    return Boosted(np.array(features_), np.array(thresholds), np.array(values))


def decode(nodes: list[Node], p: np.ndarray) -> list[int]:
    """The leaves to keep, in page order: the most probable labelling in which all below a kept or dropped node shares its label."""
    logs = np.log(np.maximum(p, 1e-9)).tolist()
    keep, drop, mixed = ([x[k] for x in logs] for k in (KEEP, DROP, MIXED))
    for i in range(len(nodes) - 1, 0, -1):
        q = nodes[i].parent
        if not nodes[i].children:
            mixed[i] = -1e18
        keep[q] += keep[i]
        drop[q] += drop[i]
        mixed[q] += max(keep[i], drop[i], mixed[i])
    out, chosen = [], [MIXED] * len(nodes)
    for i, x in enumerate(nodes):
        above = chosen[x.parent] if x.parent >= 0 else MIXED
        if above != MIXED:
            chosen[i] = above
        elif x.children or x.parent < 0:
            chosen[i] = max((KEEP, DROP, MIXED), key=lambda k: (keep, drop, mixed)[k][i])
        else:
            chosen[i] = KEEP if keep[i] >= drop[i] else DROP
        if chosen[i] == KEEP and x.tag == "#text":
            out.append(i)
    return out


def _generated(rng: random.Random) -> str:
    """A page whose elements carry data-label="k" or "d" where a part to keep or to drop starts."""
    words = lambda low, high: " ".join("".join(rng.choice("abcdefghijklmnoprstuvwy") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(low, high)))
    sentence = lambda: words(3, 18).capitalize() + rng.choice([".", ".", ".", ",", "?"])
    prose = lambda low=1, high=7: " ".join(sentence() for _ in range(rng.randint(low, high)))
    named = lambda *names: f' {rng.choice(["class", "id", "class"])}="{rng.choice(names)}{rng.choice(["", "", "-1", " x", "-box", "-wrap"])}"' if names and rng.random() < 0.9 else ""
    d = ' data-label="d"'
    link = lambda: f'<a href="/{words(1, 1)}">{words(1, 3)}</a>'

    def links(low: int, high: int) -> str:
        n = rng.randint(low, high)
        if rng.random() < 0.75:
            return "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(n)) + "</ul>"
        return rng.choice([" | ", " ", " &middot; "]).join(link() for _ in range(n))

    def nav() -> str:
        return rng.choice([f"<nav{d}>{links(2, 12)}</nav>", f"<div{named('nav', 'menu', 'navbar', 'breadcrumb', 'main-menu', 'pagination')}{d}>{links(2, 12)}</div>", f"<ul{named('menu', 'nav', 'tabs')}{d}>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 9))) + "</ul>"])

    def top() -> str:
        body = rng.choice([f"<h1>{words(1, 4)}</h1>", f"<p>{words(2, 8)}</p>", f"{link()} {words(1, 5)}", f"<div>{words(1, 3)}</div>{links(2, 6)}"])
        return rng.choice([f"<header{d}>{body}</header>", f"<div{named('header', 'masthead', 'topbar', 'site-header', 'branding')}{d}>{body}</div>"])

    def ad() -> str:
        body = rng.choice([prose(1, 2), f"<p>{prose(1, 3)}</p>", f"{link()} {words(2, 8)}", words(1, 9)])
        return f"<{(t := rng.choice(['div', 'div', 'aside', 'section', 'p']))}{named('ad', 'ads', 'advert', 'sponsored', 'promo', 'ad-banner', 'advertisement')}{d}>{body}</{t}>" if rng.random() < 0.95 else f"<aside{d}>{body}</aside>"

    def side(around: bool = True) -> str:
        body = rng.choice([f"<h3>{words(1, 3)}</h3>{links(2, 8)}", f"<p>{prose(1, 3)}</p>", f"<h2>{words(1, 3)}</h2><p>{prose(1, 2)}</p>{links(1, 5)}", prose(1, 2)])
        return rng.choice([f"<aside{named('sidebar', 'widget', '') or ''}{d}>{body}</aside>", f"<div{named('sidebar', 'widget', 'rail', 'recommended', 'trending', *['related', 'popular', 'more'] * around)}{d}>{body}</div>", f"<aside{d}>{body}</aside>"])

    def notice(around: bool = True) -> str:
        body = rng.choice([f"<p>{prose(1, 3)}</p>", f"{prose(1, 2)} {link()}", prose(1, 2)])
        return f"<{(t := rng.choice(['div', 'div', 'section', 'p']))}{named('cookie', 'cookie-notice', 'consent', 'newsletter', 'popup', 'subscribe', 'gdpr', 'modal', *['notice', 'notices'] * around)}{d}>{body}</{t}>"

    def form() -> str:
        body = rng.choice([f"<label>{words(1, 3)}</label> <input name=q> ", f"<p>{words(2, 8)}</p><input name=mail>", f"{words(1, 4)} <input> {words(1, 2)}"])
        return f"<form{named('search', 'login', 'contact', 'form')}{d}>{body}</form>"

    def comments(around: bool = True) -> str:
        one = lambda: rng.choice([f"<p>{prose(1, 4)}</p>", f"<div{named('comment', 'comment-body', 'reply')}><p>{prose(1, 3)}</p></div>", f"<li{named('comment')}>{prose(1, 3)}</li>", f"<article{named('comment')}><p>{prose(1, 3)}</p></article>"])
        body = (f"<h3>{words(1, 3)}</h3>" if rng.random() < 0.5 else "") + "".join(one() for _ in range(rng.randint(1, 6)))
        return f"<{(t := rng.choice(['section', 'div', 'ol', 'div']))}{named('comments', 'comment-list', 'disqus', 'respond', 'comments-discussion', 'reader-comments', *['discussion', 'responses', 'feedback'] * around)}{d}>{body}</{t}>"

    def share() -> str:
        return f"<div{named('share', 'social', 'sharing', 'share-buttons')}{d}>{links(2, 5) if rng.random() < 0.6 else words(1, 6)}</div>"

    def bottom() -> str:
        body = rng.choice([f"&copy; {words(1, 3)} &middot; {prose(1, 2)}", f"<p>&copy; {words(1, 6)}</p>", links(2, 8), f"<p>{prose(1, 2)}</p>{links(1, 6)}"])
        return rng.choice([f"<footer{d}>{body}</footer>", f"<footer{d}>{body}</footer>", f"<div{named('footer', 'site-footer', 'copyright', 'legal')}{d}>{body}</div>"])

    def block() -> str:
        kind = rng.random()
        if kind < 0.62:
            return rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}</b></p>", "<p><b>{}<br>"]).format(prose())
        if kind < 0.7:
            return f"<h{(k := rng.randint(2, 4))}>{words(1, 8)}</h{k}>"
        if kind < 0.77:
            return "<ul>" + "".join(f"<li>{prose(1, 2) if rng.random() < 0.6 else words(1, 6)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>"
        if kind < 0.81:
            return f"<blockquote>{rng.choice(['<p>{}</p>', '{}']).format(prose(1, 3))}</blockquote>"
        if kind < 0.85:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{words(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(2, 5))) + "</table>"
        if kind < 0.88:
            return f"<pre>{words(3, 20)}</pre>"
        if kind < 0.91:
            return f"<figure><img src=x><figcaption>{words(2, 10)}</figcaption></figure>"
        if kind < 0.95:
            return f"<p>{prose(1, 2)} {link()} {prose(1, 2)}</p>"
        return rng.choice([f"<div>{prose()}</div>", f"<div><p>{prose()}</p><p>{prose()}</p></div>", f"<section><h2>{words(1, 5)}</h2><p>{prose()}</p></section>"])

    def odd() -> str:
        """Part of an article under a name that parts around it have, too."""
        name = rng.choice("related-work related notice notices legal-background discussion responses feedback-loop contact search-method share-of popular more tags privacy-law print side-effects top bottom promotion field-notes".split())
        body = rng.choice([f"<h2>{words(1, 5)}</h2><p>{prose()}</p>", f"<p>{prose()}</p><p>{prose()}</p>", prose(1, 5), f"<h3>{words(1, 4)}</h3><p>{prose(1, 3)} {link()} {prose(1, 3)}</p>"])
        t = rng.choice(["div", "section", "div", "p"]) if "<" not in body else rng.choice(["div", "section"])
        return f'<{t} class="{name}">{body}</{t}>'

    inside = [odd() if rng.random() < 0.06 else block() for _ in range(rng.choice([1, 1, 2, 3, 4, 6, 9, 14]))]
    if rng.random() < 0.85:
        inside.insert(0, f"<h1>{words(1, 12)}</h1>")
    for part in (ad, share, side, form, notice, nav, comments):
        if rng.random() < 0.09:
            inside.insert(rng.randint(0, len(inside)), part(False) if part in (side, notice, comments) else part())
    content = rng.choice(["<article{0}>{1}</article>"] * 4 + ["<main{0}>{1}</main>", "<main><article{0}>{1}</article></main>"] + ['<div class="{2}"{0}>{1}</div>'] * 3 + ["<div{0}>{1}</div>", "<section{0}>{1}</section>", "<body{0}>{1}"]).format(
        ' data-label="k"', "".join(inside), rng.choice(["content", "article", "post", "entry-content", "story-body", "main-content", "post-body", "article-text"])
    )
    head = [p() for p in (nav, top, ad, notice, form) if rng.random() < 0.45]
    tail = [p() for p in (side, comments, share, ad, nav, notice, form) if rng.random() < 0.28]
    rng.shuffle(head), rng.shuffle(tail)
    if rng.random() < 0.10:  # a page that is nothing but its text
        head, tail = [], []
        if rng.random() < 0.6:
            content = f'<body data-label="k">{"".join(inside)}'
    tail += [bottom()] if rng.random() < 0.85 else []
    if rng.random() < 0.25:
        content = f"<div{named('wrapper', 'container', 'page', 'row')}>{''.join(head[1:])}{content}{''.join(tail[:1])}</div>"
        head, tail = head[:1], tail[1:]
    return f"<html><body>{''.join(head)}{content}{''.join(tail)}</body></html>"


def labelled(html: str) -> tuple[list[Node], np.ndarray]:
    """Nodes of a generated page and their labels: of leaves by the nearest mark above, of others by their leaves."""
    nodes = parse(html)
    mark, labels = [DROP] * len(nodes), np.full(len(nodes), -1)
    for i, x in enumerate(nodes):
        if x.parent >= 0:
            mark[i] = mark[x.parent]
        if (at := x.attributes.find('data-label="')) >= 0:
            mark[i] = KEEP if x.attributes[at + 12] == "k" else DROP
            x.attributes = x.attributes[:at] + x.attributes[at + 14 :]
        if not x.children:
            labels[i] = mark[i]
    for i in range(len(nodes) - 1, 0, -1):
        q = nodes[i].parent
        labels[q] = labels[i] if labels[q] in (-1, labels[i]) else MIXED
    return nodes, labels


@lru_cache(maxsize=1)
def trained(pages: int = TRAIN_PAGES, seed: int = 7) -> Boosted:
    rng, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        nodes, y = labelled(_generated(rng))
        xs.append(features(nodes))
        ys.append(y)
    return boost(np.concatenate(xs), np.concatenate(ys))


def main_text(html: str, model: Boosted) -> str:
    nodes = parse(html)
    return "\n".join(nodes[i].text for i in decode(nodes, model.probabilities(features(nodes))))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html).

    A null or empty page, and one without main text, has the empty text. Malformed and truncated
    pages are read as far as they go, in time that grows with their length. Where keeping and dropping
    a block are as likely, it is kept. Repeated rows stay repeated; an empty table gives none; other
    columns are ignored. Nothing of a page is dropped for its length.
    """
    model = pages.sparkSession.sparkContext.broadcast(trained())  # ROUNDS x 3 small trees

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boosted = model.value
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                trees = [parse(x.decode("utf-8", "replace") if x else "") for x in part.column(2).to_pylist()]
                p = boosted.probabilities(np.concatenate([features(t) for t in trees]))
                texts, at = [], 0
                for t in trees:
                    texts.append("\n".join(t[i].text for i in decode(t, p[at : at + len(t)])))
                    at += len(t)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    return map_batches(rows, extracted, "page_id long, url string, text string, n_chars long")
