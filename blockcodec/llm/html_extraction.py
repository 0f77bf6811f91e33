"""Main text of web pages, by boosted trees over DOM nodes.

A tolerant parser makes the tree of a page's block elements. Gradient-boosted
trees give each node the probability that it is, or leads to, main text, from
its subtree's density, its attribute tokens, its depth and its siblings.
Decoding is hierarchical: the likeliest labelling in which nothing below a
dropped node is kept, found from the leaves up.

The trees are trained here, on pages that a generator lays out and marks.
"""

from __future__ import annotations

import functools
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .html_pages import training_pages

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Fixed values of HTML: how elements behave.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img input meta link base col embed source track param area hr picture".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset("head script style template noscript title textarea select option button iframe svg math object canvas audio video".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
HEAD_ONLY = frozenset("title script style meta link base noscript template".split())
SELF_CLOSING = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table", "tbody", "thead", "tfoot")), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)), "tbody": ("tr td th thead tbody tfoot", ("table",)), "thead": ("tr td th thead tbody tfoot", ("table",)), "tfoot": ("tr td th thead tbody tfoot", ("table",))}

# What names in class, id and role say.
GOOD_TOKENS = frozenset("article articles content main post entry story body text page blog prose copy".split())
BAD_TOKENS = frozenset("ad ads advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments discussion reply replies disqus cookie cookies consent notice alert gdpr footer foot header head masthead menu nav navbar navigation newsletter subscribe signup login pager pagination popup modal promo promoted promotion related recommended recommendations rail share sharing social sidebar side sponsor sponsored tags toolbar topbar widget widgets skip copyright legal form search overlay teaser outbrain taboola".split())
TAGS = ("article", "main", "section", "div", "p", "h", "list", "nav", "header", "footer", "aside", "form", "table", "quote", "body")
GROUPS = {"article": 0, "main": 1, "section": 2, "div": 3, "p": 4, **{f"h{i}": 5 for i in range(1, 7)}, **dict.fromkeys(("ul", "ol", "li", "dl", "dt", "dd", "menu"), 6), "nav": 7, "header": 8, "footer": 9, "aside": 10, **dict.fromkeys(("form", "fieldset", "dialog"), 11), **dict.fromkeys(("table", "tbody", "thead", "tfoot", "tr", "td", "th"), 12), **dict.fromkeys(("blockquote", "pre", "figure", "figcaption"), 13), **dict.fromkeys(("html", "body"), 14)}


class Stack:
    """The open elements, and where each kind of them is: no search goes over
    all that is open, however deep a page nests."""

    def __init__(self, tags: list[str]):
        self.tags, self.nodes, self.at = tags, [0], {}

    @property
    def top(self) -> int:
        return self.nodes[-1]

    def push(self, node: int) -> None:
        self.at.setdefault(self.tags[node], []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, k: int) -> None:
        """Close all from place k on."""
        for node in self.nodes[k:]:
            self.at[self.tags[node]].pop()
        del self.nodes[k:]

    def last(self, *names: str) -> int:
        """The place of the innermost element of these names; 0 if none is open."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=0)

    def lowest(self, names, stop: int) -> int:
        """The place of the outermost element of these names above stop."""
        places = [p for n in names for p in self.at.get(n, ()) if p > stop]
        return min(places, default=len(self.nodes))


class Page:
    """The block elements of a page in page order, and its texts."""

    def __init__(self, source: str, marked: bool = False):
        self.marked = marked  # a training page, with data-mark attributes
        self.tag, self.parent, self.good, self.bad, self.mark = ["html"], [-1], [0], [0], [None]
        self.hidden = [False]
        #: (node, text, in a link); a node that goes on after a child does so
        #: in a new run.
        self.runs: list[tuple[int, list[str], list[int]]] = []
        stack, at, link, open_run = Stack(self.tag), 0, 0, -1
        for m in TOKEN.finditer(source):
            if m.start() < at:  # within a raw text element
                continue
            if m.start() > at:
                open_run = self._text(source[at : m.start()], stack.top, link, open_run)
            at = m.end()
            tag = m["tag"] or m["tag2"]
            if not tag:
                continue
            tag, end = tag.lower(), m["end"] or m["end2"]
            if tag == "a":
                link = 0 if end else 1
            if tag in ("br", "hr", "img") and not end:
                open_run = self._text(" ", stack.top, 0, open_run)
            if tag == "hr":
                open_run = -1
            if tag in INLINE:
                continue
            if end:
                if tag in ("html", "body"):
                    continue
                if (k := stack.last(tag)) > 0:
                    stack.cut(k)
                    open_run = -1
                continue
            if tag == "html":
                continue
            attrs = m["attrs"] if m["tag"] else m["attrs2"]
            self._make_room(tag, stack)
            node = self._open(tag, attrs or "", stack.top)
            open_run = -1
            if tag in RAW:
                closing = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
                at = closing.end() if closing else len(source)
            elif not (attrs or "").endswith("/") or tag in GROUPS:
                stack.push(node)
        if at < len(source):
            self._text(source[at:], stack.top, link, open_run)

    def _make_room(self, tag, stack):
        """Close what the start of tag closes."""
        if tag not in HEAD_ONLY and tag != "head" and self.tag[stack.top] == "head":
            stack.cut(len(stack.nodes) - 1)
        if tag in CLOSES_P and (k := stack.last("p")) > stack.last("td", "th", "button", "table", "object"):
            stack.cut(k)
        if tag in SELF_CLOSING:
            closes, until = SELF_CLOSING[tag]
            closes = closes.split()
            stop = stack.last(*(u for u in until if u not in closes))
            found = [k for c in closes if (k := stack.last(c)) > stop]
            if (own := stack.last(tag)) > stop:
                stack.cut(own)  # with what is open above it
            elif found:
                stack.cut(min(stack.lowest(closes, stop), *found))

    def _open(self, tag, attrs, parent):
        good = bad = 0
        mark = None
        hidden = tag in NEVER
        if attrs:
            for name, a, b, c in ATTRIBUTE.findall(attrs):
                name = name.lower()
                if name in ("class", "id", "role", "itemprop", "aria-label"):
                    parts = {p.lower() for p in NAME_PARTS.findall(a or b or c)}
                    good += len(parts & GOOD_TOKENS)
                    bad += len(parts & BAD_TOKENS)
                elif self.marked and name == "data-mark":
                    mark = int(a or b or c)
                elif name == "style" and re.search(r"display\s*:\s*none", a or b or c, re.I):
                    hidden = True
        self.tag.append(tag)
        self.parent.append(parent)
        self.good.append(good)
        self.bad.append(bad)
        self.mark.append(mark)
        self.hidden.append(hidden or self.hidden[parent])
        return len(self.tag) - 1

    def _text(self, text, node, link, open_run):
        if self.hidden[node]:
            return open_run
        if "&" in text:
            text = html.unescape(text)
        if open_run < 0:
            if not text.strip():
                return open_run
            self.runs.append((node, [], [0]))
            open_run = len(self.runs) - 1
        run = self.runs[open_run]
        run[1].append(text)
        if link:
            run[2][0] += len(text)
        return open_run

    def text(self, kept) -> str:
        blocks = (" ".join("".join(parts).split()) for node, parts, _ in self.runs if kept[node])
        return " ".join(b for b in blocks if b)

    def features(self) -> np.ndarray:
        n = len(self.tag)
        parent = np.array(self.parent)
        group = np.array([GROUPS.get(t, 3) for t in self.tag])
        chars, links, words, stops, runs = (np.zeros(n) for _ in range(5))
        for node, parts, link in self.runs:
            t = "".join(parts)
            chars[node] += len(t)
            links[node] += min(link[0], len(t))
            words[node] += t.count(" ") + 1
            stops[node] += t.count(".") + t.count(",") + t.count("!") + t.count("?")
            runs[node] += 1
        own = chars.copy()
        nodes, paras, bads = np.ones(n), (group == 4).astype(float), np.array(self.bad, float)
        bads += np.isin(group, (7, 9, 10, 11))
        below_bad = bads.copy()
        paratext = np.where((group == 4) | (group == 5), chars, 0)
        for i in range(n - 1, 0, -1):
            p = parent[i]
            for a in (chars, links, words, stops, nodes, paras, below_bad, paratext, runs):
                a[p] += a[i]
        depth, above_bad, above_good, in_article, kids, place = (np.zeros(n) for _ in range(6))
        good = np.array(self.good, float)
        for i in range(1, n):
            p = parent[i]
            depth[i] = depth[p] + 1
            above_bad[i] = above_bad[p] + bads[p]
            above_good[i] = above_good[p] + good[p]
            in_article[i] = in_article[p] or group[p] in (0, 1)
            place[i] = kids[p]
            kids[p] += 1
        up = np.maximum(parent, 0)
        size = np.maximum(chars, 1)
        has_article = np.full(n, float(((group == 0) | (group == 1)).any()))
        wide = np.zeros(n)
        np.maximum.at(wide, up[1:], chars[1:])
        cols = [group == k for k in range(len(TAGS))]
        cols += [np.log1p(chars), np.log1p(own), links / size, stops / np.maximum(words, 1), words / np.maximum(nodes, 1), paras, paratext / size, np.log1p(nodes), runs, good, bads, np.minimum(below_bad, 20), above_good, np.minimum(above_bad, 5), in_article, has_article, depth, kids, place, kids[up] - place, chars / size[up], chars / max(1, chars[0]), chars >= wide[up], group[up], bads[up], good[up]]
        return np.column_stack(cols).astype(float)


def decode(parent, p: np.ndarray) -> np.ndarray:
    """The likeliest consistent labelling: kept nodes have kept ancestors."""
    p = np.clip(p, 1e-6, 1 - 1e-6)
    keep, drop = np.log(p), np.log(1 - p)
    best_keep = keep.copy()  # of the node kept, with the best of each child
    for i in range(len(p) - 1, 0, -1):
        best_keep[parent[i]] += max(best_keep[i], drop[i])
        drop[parent[i]] += drop[i]
    kept = np.zeros(len(p), bool)
    for i in range(len(p)):
        kept[i] = (i == 0 or kept[parent[i]]) and best_keep[i] >= drop[i]
    return kept


def _labels(page: Page) -> np.ndarray:
    """1 for main text and all that leads to it; marks are inherited."""
    mark, y = list(page.mark), np.zeros(len(page.tag))
    texts = {node for node, _, _ in page.runs}
    for i in range(1, len(mark)):
        mark[i] = mark[page.parent[i]] if mark[i] is None else mark[i]
    for i in range(len(mark) - 1, -1, -1):
        y[i] = y[i] or (bool(mark[i]) and (i in texts))
        if i and y[i]:
            y[page.parent[i]] = 1
    return y


@functools.lru_cache(1)
def trained(pages: int = 500, seed: int = 23) -> boosting.Boosted:
    parsed = [Page(s, marked=True) for s in training_pages(pages, seed)]
    x, y = np.vstack([p.features() for p in parsed]), np.concatenate([_labels(p) for p in parsed])
    return boosting.fit(x, y)


def extract(sources, model: boosting.Boosted) -> list[str]:
    pages = [Page(s or "") for s in sources]
    x = [p.features() for p in pages]
    prob, at, out = model.probability(np.vstack(x)) if x else (), 0, []
    for page, f in zip(pages, x):
        out.append(page.text(decode(page.parent, prob[at : at + len(f)])))
        at += len(f)
    return out


def _extract(model):
    def run(batches):
        for batch in batches:
            sources, texts = batch.column("html").to_pylist(), []
            for at in range(0, len(sources), 64):
                texts += extract(sources[at : at + 64], model)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract_pages(pages: DataFrame, model: boosting.Boosted | None = None) -> DataFrame:
    """One row for each row of pages: page_id, url, text, n_chars.

    A null or empty html, or one without main text, gives an empty text. White
    space within a block becomes one space; blocks are joined by one space.
    Broken and cut-off markup is read as far as it goes. page_id and url pass
    through, null or repeated ones too; other columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract(model or trained()), "page_id long, url string, text string, n_chars long")
