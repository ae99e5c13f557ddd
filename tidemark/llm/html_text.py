"""HTML extraction by maximum-scoring subsequence.

A page is a sequence of words and tags. Words score by where they stand, tags cost, and a linear scan finds the contiguous
stretch with the largest sum: the content. All scores come from labelled pages, those whose markup itself names its content
(an ``article`` or ``main`` element): how often words under an element name, class, id or role stand inside the content and
how often outside, and the same for words by kind of block and link density where no such mark decides. Names that no
labelled page holds fall back on a few pseudo-counts.

An element whose words score negative is one token of the sequence, like a tag: it costs a bounded amount, so that the scan
bridges an advert inside an article, and it adds no text. An element that holds the content itself is never such a token,
whatever its class says.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, map_arrow, row_hash, written

#: About so many labelled pages are counted, and so many features kept at most, the most frequent ones.
MAX_LABELLED = 2000
MAX_FEATURES = 50_000
#: The largest weight of a word, the weight under which an element is a token of its own, and what such a token costs at most.
MOST, BOX, BRIDGE = 3.0, -0.7, 4.0

# Element names.
RAW = frozenset("script style noscript template iframe svg title textarea object video audio canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What browsers show as blocks or parts of tables. All else, unknown elements too, stands in a line and parts no block.
BLOCKS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li listing main menu nav ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead tr ul xmp".split()
)
BOXES = frozenset("nav header footer aside form button select dialog menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSE_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CONTENT = frozenset(("article", "main"))
#: Words of a class, id or role that mark an element off wherever they stand in it, and those that do only on their own.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot adsense sponsor sponsored navbar navigation breadcrumb breadcrumbs pagination sidebar cookie cookies consent gdpr newsletter "
    "comment comments commentlist disqus masthead colophon contentinfo paywall hidden".split()
)
LONE_MARKS = frozenset(
    "nav menu header footer aside related recommended widget teaser trending popular promo promotion notice popup modal overlay banner complementary form login signup search searchbox share "
    "sharing social toolbar tabs copyright subscribe subscription dialog replies".split()
)
NOT_A_MARK = frozenset(("has", "no", "with", "without", "is", "not"))

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/>\"']|$)", re.I)
_NONE_SHOWN = re.compile(r"display\s*:\s*none", re.I)
_PARTS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_AFTER_QUOTE = re.compile(r"[<>]")
_SPECIAL = re.compile(r"[>\"']")


class Finder:
    """``find`` over one page that remembers what it did not find, so that many failing searches cost one."""

    def __init__(self, html: str):
        self.html, self.folded, self.none_from, self.quotes_fail = html, None, {}, False

    def find(self, what: str, at: int) -> int:
        if self.none_from.get(what, len(self.html) + 1) <= at:
            return -1
        found = self.html.find(what, at)
        if found < 0:
            self.none_from[what] = min(at, self.none_from.get(what, at))
        return found

    def closing(self, name: str, at: int) -> int:
        """Where ``</name`` stands next, in any case."""
        if self.folded is None:
            self.folded = Finder(self.html.translate({c: c + 32 for c in range(65, 91)}))
        return self.folded.find(f"</{name}", at)


def tag_end(page: Finder, at: int) -> int:
    """Where the tag ends whose name ends at ``at``: its ``>``, or the page's end. A quote that never closes, or closes in a later tag, is none."""
    html = page.html
    gt = page.find(">", at)
    if gt < 0 or page.quotes_fail:
        return gt
    while True:
        special = _SPECIAL.search(html, at)
        if special is None:
            page.quotes_fail = True  # quotes swallow the rest of the page: from here on they are none
            return gt
        i = special.start()
        if html[i] == ">":
            return i
        before = i - 1
        while before > 0 and html[before].isspace():
            before -= 1
        if html[before] != "=":
            at = i + 1
            continue
        close = page.find(html[i], i + 1)
        if close < 0:
            at = i + 1
            continue
        angle = _AFTER_QUOTE.search(html, i + 1, close)
        if angle is not None and angle.group() == ">" and html.find("<", angle.end(), close) >= 0:
            return angle.start()
        at = close + 1


def marks(name: str, attributes: str) -> list[str]:
    """The names by which an element may be told: its element name if that parts a page, and its class, id and role."""
    out = [f"tag:{name}"] if name in BOXES else []
    if not attributes or name in CONTENT or name in HEADINGS or name in ("html", "body", "p"):
        return out
    for kind, *values in _ATTRIBUTE.findall(attributes):
        value, kind = "".join(values), kind.lower()
        if kind == "hidden" or (kind == "aria-hidden" and value.lower() == "true") or (kind == "style" and _NONE_SHOWN.search(value)):
            out.append("hidden")
        elif kind in ("class", "id", "role"):
            out += [f"name:{x.lower()}" for x in _CAMEL.sub("-", value).split()]
    return out


def pseudo(feature: str) -> tuple[float, float]:
    """Words inside and outside the content that a feature is taken to have had before any page was seen."""
    kind, _, rest = feature.partition(":")
    if kind in ("tag", "hidden"):
        return 0.2, 4.0
    if kind == "name":
        parts = _PARTS.findall(rest)
        if rest in LONE_MARKS or any(p in MARKS and (not i or parts[i - 1] not in NOT_A_MARK) for i, p in enumerate(parts)):
            return 0.5, 4.0
        return 2.0, 2.0
    if kind == "word":
        return (1.0, 2.0) if rest.endswith(":2") else (3.0, 1.5) if rest.startswith(("item", "cell")) else (4.0, 1.0)
    return 0.5, 0.1  # a tag's cost


class Page:
    """A page as a tree and a sequence of texts and tags.

    Nodes are numbered in page order: parent, names (``marks``), content (inside an article or main element), kind and link
    of the block that their words belong to. Events are (node, block, words, text): words < 0 for a tag, whose name stands
    in ``text``.
    """

    def __init__(self, html: str):
        self.parent, self.names, self.tag, self.kind, self.link, self.content = [-1], [[]], [""], ["plain"], [False], [False]
        self.events: list[tuple[int, int, int, str]] = []
        self.block = 0
        self._stack, self._blocks, self._items, self._open = [0], [0], [], Counter()
        self._read(Finder(html))

    def _read(self, page: Finder) -> None:
        html, at, n = page.html, 0, len(page.html)
        while at < n:
            lt = page.find("<", at)
            stop = n if lt < 0 else lt
            while 0 <= lt < n - 1 and not (html[lt + 1].isalpha() and html[lt + 1].isascii() or html[lt + 1] in "/!?"):
                lt = page.find("<", lt + 1)  # a sign, not a tag
                stop = n if lt < 0 else lt
            if lt == n - 1:
                stop = n
            if stop > at:
                self._text(html[at:stop])
            if stop == n:
                return
            at = self._markup(page, stop)

    def _markup(self, page: Finder, at: int) -> int:
        """Read what begins with ``<`` at ``at``; the place after it."""
        html = page.html
        if html.startswith("<!--", at):
            end = page.find("-->", at + 2)
            if end >= 0:
                return end + 3
        if html[at + 1] in "!?" or (html[at + 1] == "/" and not html[at + 2 : at + 3].isalpha()):
            end = page.find(">", at)
            return len(html) if end < 0 else end + 1
        slash = html[at + 1] == "/"
        name = _NAME.match(html, at + 1 + slash)
        if name is None:
            end = page.find(">", at)
            return len(html) if end < 0 else end + 1
        end = tag_end(page, name.end())
        if end < 0:  # no tag ends here: only its name is markup
            end = name.end() - 1
        attributes, name = html[name.end() : end], name.group().lower()
        if slash:
            self._close(name)
            return end + 1
        if name in RAW and not attributes.endswith("/"):
            close = page.closing(name, end + 1)
            if close >= 0:
                gt = page.find(">", close)
                return len(html) if gt < 0 else gt + 1
            return len(html) if name in ("script", "style") else end + 1
        self._open_element(name, attributes)
        return end + 1

    def _text(self, raw: str) -> None:
        text = unescape(raw) if "&" in raw else raw
        self.events.append((self._stack[-1], self.block, len(text.split()), text))

    def _pop_to(self, depth: int) -> None:
        while len(self._stack) > depth:
            node = self._stack.pop()
            self._open[self.tag[node]] -= 1
            if self._blocks[-1] == node:
                self._blocks.pop()
            if self._items and self._items[-1] == node:
                self._items.pop()

    def _close(self, name: str) -> None:
        if name in BLOCKS:
            self.block += 1
        if self._open[name] > 0:
            depth = len(self._stack) - 1
            while self.tag[self._stack[depth]] != name:
                depth -= 1
            self.events.append((self.parent[self._stack[depth]], self.block, -1, name))
            self._pop_to(depth)

    def _depth_of(self, node: int) -> int:
        depth = len(self._stack) - 1
        while self._stack[depth] != node:
            depth -= 1
        return depth

    def _open_element(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            self.block += 1
        if name == "br":
            self.events.append((self._stack[-1], self.block, 0, " "))
        if name in CLOSE_P and self.tag[self._blocks[-1]] == "p":
            self._pop_to(self._depth_of(self._blocks[-1]))
        if name == "li" and self._items and self.tag[self._items[-1]] == "li":
            self._pop_to(self._depth_of(self._items[-1]))
        top = self._stack[-1]
        if name in VOID or attributes.endswith("/"):
            self.events.append((top, self.block, -1, name))
            return
        node = len(self.parent)
        self.parent.append(top)
        self.tag.append(name)
        inner = self.content[top]
        found = marks(name, attributes)
        if found and found[0] == "tag:header" and inner:
            found = found[1:]  # an article's own header holds its title
        self.names.append(found)
        self.content.append(inner or name in CONTENT)
        kind = "heading" if name in HEADINGS else "item" if name in ("li", "dd", "dt") else "cell" if name in ("td", "th") else "p" if name in ("p", "pre", "blockquote") else None
        self.kind.append(kind or self.kind[top])
        self.link.append(self.link[top] or name == "a")
        self.events.append((node, self.block, -1, name))
        self._stack.append(node)
        self._open[name] += 1
        if name in BLOCKS:
            self._blocks.append(node)
        if name in ("li", "ul", "ol"):
            self._items.append(node)

    def words_below(self, inside: bool | None = None) -> list[int]:
        """Words under each node; those inside or outside the content only, if asked."""
        total = [0] * len(self.parent)
        for node, _, words, _ in self.events:
            if words > 0 and (inside is None or self.content[node] == inside):
                total[node] += words
        for node in range(len(total) - 1, 0, -1):
            total[self.parent[node]] += total[node]
        return total

    def word_features(self) -> list[str]:
        """For each event with words, by the kind of its block and how much of the block is links."""
        words, links = Counter(), Counter()
        for node, block, n, _ in self.events:
            if n > 0:
                words[block] += n
                links[block] += n if self.link[node] else 0
        return [f"word:{self.kind[node]}:{0 if not links[block] else 1 if 2 * links[block] < words[block] else 2}" if n > 0 else "" for node, block, n, _ in self.events]

    def kept_open(self) -> set[int]:
        """Nodes that hold the content and are never tokens of their own: those about the main element, or else the longest article."""
        below = self.words_below()
        tops = [i for i in range(len(self.parent)) if self.tag[i] in CONTENT and not self.content[self.parent[i]] and below[i]]
        mains = [i for i in tops if self.tag[i] == "main"]
        best = max(mains or tops, key=lambda i: below[i], default=None)
        out: set[int] = set()
        while best is not None and best >= 0:
            out.add(best)
            best = self.parent[best]
        return out


def weight(counts: dict[str, tuple[float, float]], feature: str) -> float:
    """Log odds of content against the rest under ``feature``; for tags a cost that grows with their share outside."""
    inside, outside = counts.get(feature, (0.0, 0.0))
    a, b = pseudo(feature)
    if feature.startswith("cost:"):
        return -0.1 - (outside + b) / (inside + outside + a + b)
    return max(-MOST, min(MOST, math.log((inside + a) / (outside + b))))


class Weights(dict):
    """Weights by feature, from counts of words inside and outside the content; features that were not counted have their pseudo-counts."""

    def __init__(self, counts: dict[str, tuple[float, float]]):
        super().__init__()
        self.counts = counts

    def __missing__(self, feature: str) -> float:
        w = weight(self.counts, feature)
        if len(self) < 4 * MAX_FEATURES:
            self[feature] = w
        return w


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """(start, end) of the contiguous stretch with the largest positive sum, the first and shortest of equals; (0, 0) if none."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def boxes(page: Page, weights: dict[str, float], about: set[int]) -> list[int]:
    """For each node the outermost element about it that is a token of its own, -1 if none; nodes in ``about`` never are."""
    out = [-1] * len(page.parent)
    for node in range(1, len(out)):
        up = out[page.parent[node]]
        if up >= 0:
            out[node] = up
        elif node not in about and page.names[node] and min(weights[x] for x in page.names[node]) < BOX:
            out[node] = node
    return out


def page_boxes(page: Page, weights: dict[str, float]) -> list[int]:
    """``boxes``, with wrappers told: without a named content, the element that holds its words, or its title and most words, is a wrapper."""
    about = page.kept_open()
    box = boxes(page, weights, about)
    if about:
        return box
    # Only one element of any depth holds most words, so wrappers lie on one path; each is told by the words left outside it.
    below, titles = page.words_below(), [tag == "h1" for tag in page.tag]
    total, n = below[0], len(page.parent)
    for node in range(n - 1, 0, -1):
        titles[page.parent[node]] |= titles[node]
    depth = [0] * n  # of the deepest element with most words that a node is in, from 1
    path = [0]
    for node in range(1, n):
        up = page.parent[node]
        depth[node] = depth[up]
        if up == path[-1] and 2 * below[node] > total:
            path.append(node)
            depth[node] += 1
    aside = boxes(page, weights, set(path))
    left = [0] * len(path)
    for node, _, words, _ in page.events:
        if words > 0 and aside[node] < 0:
            left[depth[node]] += words
    outside = 0
    for k in range(1, len(path)):
        outside += left[k - 1]
        node = path[k]
        if page.names[node] and min(weights[x] for x in page.names[node]) < BOX:
            if page.tag[node] in ("nav", "footer") or not (titles[node] or 10 * outside < total):
                break
            about.add(node)
    return boxes(page, weights, about)


def content(html: str, weights: dict[str, float]) -> str:
    """The text of the page's content: blocks joined by two newlines.

    White space inside a block becomes one space. A page without words, or whose words all score negative, gives an empty text.
    """
    page = Page(html)
    box = page_boxes(page, weights)
    features = page.word_features()
    named = sum(n for node, _, n, _ in page.events if n > 0 and box[node] < 0 and page.content[node])
    plain = sum(n for node, _, n, _ in page.events if n > 0 and box[node] < 0)
    named = 4 * named >= plain > 0 and named > 0  # the markup names the content, and not just a part of it
    scores, texts, boxed = [], [], {}
    for (node, block, n, text), feature in zip(page.events, features):
        b = box[node]
        inner = named and page.content[b if b >= 0 else node]
        if b >= 0:
            if b not in boxed:
                boxed[b] = len(scores)
                scores.append(0.0)
                texts.append(None)
            if n > 0:
                scores[boxed[b]] = max(-0.1 if inner else -BRIDGE, scores[boxed[b]] - MOST * n)
        elif n < 0:
            scores.append(-0.01 if inner else weights["cost:" + text])
            texts.append(None)
        else:
            scores.append(n * (MOST if inner else -MOST if named else weights[feature]))
            texts.append((block, text))
    start, end = best_stretch(scores)
    blocks: dict[int, list[str]] = {}
    for item in texts[start:end]:
        if item is not None:
            blocks.setdefault(item[0], []).append(item[1])
    joined = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(x for x in joined if x)


def mark_counts(html: str) -> tuple[Counter, Counter]:
    """Words inside and outside a labelled page's content under each name, and tags inside and outside."""
    page = Page(html)
    inside, outside, about = page.words_below(True), page.words_below(False), page.kept_open()
    a, b = Counter(), Counter()
    for node, names in enumerate(page.names):
        if names and node not in about:
            for x in set(names):
                a[x] += inside[node]
                b[x] += outside[node]
    for node, _, n, text in page.events:
        if n < 0 and text not in CONTENT:
            (a if page.content[node] else b)["cost:" + text] += 1
    return a, b


def word_counts(html: str, weights: dict[str, float]) -> tuple[Counter, Counter]:
    """Words inside and outside a labelled page's content by kind of block, where no name has decided."""
    page = Page(html)
    box = boxes(page, weights, page.kept_open())
    a, b = Counter(), Counter()
    for (node, _, n, _), feature in zip(page.events, page.word_features()):
        if n > 0 and box[node] < 0:
            (a if page.content[node] else b)[feature] += n
    return a, b


def _counted(pages: DataFrame, count, max_features: int) -> dict[str, tuple[float, float]]:
    """(inside, outside) by feature over ``pages``: the most frequent features, at most ``max_features``."""

    def run(batch: pa.RecordBatch) -> pa.Table:
        inside, outside = Counter(), Counter()
        for html in batch.column("html").to_pylist():
            a, b = count(html or "")
            inside.update(a)
            outside.update(b)
        names = sorted({*inside, *outside})
        return pa.table({"feature": pa.array(names, pa.string()), "inside": pa.array([inside[x] for x in names], pa.int64()), "outside": pa.array([outside[x] for x in names], pa.int64())})

    rows = map_arrow(pages, run, "feature string, inside long, outside long").groupBy("feature").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    top = rows.orderBy(F.desc(F.col("inside") + F.col("outside")), "feature").limit(max_features).collect()
    return {r["feature"]: (r["inside"], r["outside"]) for r in top}


def fit(pages: DataFrame, max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES, seed: int = 4) -> Weights:
    """Weights from about ``max_labelled`` labelled pages, drawn by the hash of their html.

    First names and tags are counted, then the words that no name marks off. At most ``max_features`` features of either
    kind reach the driver.
    """
    labelled = pages.where(F.col("html").rlike("(?i)<(article|main)[ >]")).select("html")
    n = labelled.count()
    share = min(1.0, max_labelled / n) if n else 1.0
    drawn = written(labelled.where(F.pmod(row_hash("html", seed=seed), F.lit(1 << 20)) < int(share * (1 << 20))), "labelled")
    counts = _counted(drawn, mark_counts, max_features)
    words = _counted(drawn, lambda html: word_counts(html, Weights(counts)), max_features)
    forget(drawn)
    return Weights(counts | words)


def extracted(pages: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html); n_chars: code points of text.

    A null, empty or textless html gives an empty text. Repeated rows, and rows with a null page_id or url, give a row each;
    no row depends on another's place, so there are no ties. Columns of other names are not read. A page is parsed in
    time and memory linear in its length, however broken its markup. An empty table gives an empty table; without labelled
    pages the weights are those of the pseudo-counts.
    """
    counts = fit(pages, max_labelled).counts
    base = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = Weights(counts)
        texts = [content(html or "", known) for html in batch.column("html").to_pylist()]
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(sizes)], ["page_id", "url", "text", "n_chars"])

    kinds = {c: base.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return map_arrow(base, run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
