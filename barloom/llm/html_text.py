"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks. A small fixed linear classifier gives each
block a cost for being called content and one for being called boilerplate:
those are its capacities to the two terminals. Blocks that follow each other
are tied by an edge that weakens with the steps between them in the element
tree, and blocks of one parent by an edge of their own. The maximum flow's cut
labels all blocks at once; the content side is the text.

Evidence is graded: length, links, sentences, headings, paragraphs, elements
and words of class, id and role each add or take some hundredths of a nat, as
much as a few edges are worth. A class name speaks against a block in full only
when all its words do ("cookie-notice"), else in part ("popular-science"), and
what stands around the block can outvote it. A short text that asks to accept
cookies speaks against itself outside a main element.

What all of a page has in common tells nothing apart. So where the cut leaves no
block but headings, costs are taken once more: no block is held for boilerplate
beforehand, and forms and elements with a loose name ("modal-body", "popular")
say nothing if they hold a paragraph and at least half of the prose. Navigation,
footers, comments, adverts, cookie notices and links stay what they are.

White space inside a block becomes one space, blocks are joined by a newline in
page order, character references are decoded. Nothing else is dropped or cut.
Null and empty pages, pages without markup and truncated pages are all defined:
no blocks give an empty text, a page without any tag is its own text, open
elements end with the page. Repeated rows are treated alike; other columns pass
through.
"""

from __future__ import annotations

import html
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import row_slices

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
NAMES = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
CONCEALED = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)

RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template", "svg", "math", "object", "canvas", "audio", "video", "select", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"html", "body", "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "caption", "tbody", "thead", "tfoot", "tr", "ul"}
#: Elements that a start tag of the same group closes.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCE = {"table", "ul", "ol", "dl", "article", "section", "div", "main", "aside", "nav", "footer", "header", "body", "form", "menu"}
SIDE_TAGS = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "label", "fieldset", "search"}
MAIN_TAGS = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Words of class, id and role that speak for boilerplate, for content, and for neither.
SIDE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promoted", "promotion", "banner", "sidebar", "widget", "widgets", "related", "recommended", "trending", "popular", "comment", "comments", "respond", "replies", "disqus", "discussion", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "pagination", "pager", "footer", "copyright", "masthead", "topbar", "toolbar", "search", "complementary", "contentinfo", "alertdialog", "skip"}
MAIN_WORDS = {"article", "content", "post", "entry", "story", "main", "body", "text"}
#: Those of them that may stand around a whole article.
LOOSE_WORDS = {"alert", "banner", "discussion", "modal", "notice", "notices", "notification", "overlay", "popular", "popup", "promo", "promoted", "promotion", "recommended", "related", "search", "sidebar", "toolbar", "topbar", "trending", "widget", "widgets"}
#: What cookie notices say, in a few languages. Fixed values.
NOTICE = re.compile(r"\bcookies?\b.*\b(?:accept|accepter|acceptez|aceptar|aceptas|akzeptieren|agree|allow|consent|einverstanden|zustimmen)\b", re.IGNORECASE | re.DOTALL)
PLAIN_WORDS = MAIN_WORDS | {"area", "bar", "block", "bottom", "box", "col", "column", "container", "form", "global", "group", "inner", "item", "items", "left", "link", "links", "list", "module", "outer", "page", "panel", "posts", "primary", "right", "row", "secondary", "section", "site", "stories", "top", "wrap", "wrapper"}
#: Classifier weights, in hundredths of a nat. A step in the tree of elements counts once.
BASE, MAIN, NAMED, SIDE, PARTLY_SIDE, HIDDEN, MOST_SIDE = -100, 260, 80, -420, -120, -700, -900
HEADING, PARAGRAPH, SENTENCE, PER_100_CHARS, MOST_CHARS, LINKED, SAYS_NOTICE = 80, 80, 40, 60, 240, -260, -240
#: Characters of a paragraph, and the most of a notice.
PROSE, SHORT = 100, 300
#: Smoothness: between neighbours (a quarter for each step beyond siblings' two), and between children of one parent.
NEXT, SIBLING = 80, 60


class _Node:
    """An open element: what it and the elements around it say about its blocks."""

    __slots__ = ("tag", "main", "side", "named", "closed", "linked", "loose", "number", "up", "depth")

    def __init__(self, tag, parent, attributes, number, spared=frozenset()):
        self.tag, self.number, self.up, self.loose = tag, number, parent, False
        if parent is None:
            self.main, self.side, self.named, self.closed, self.linked, self.depth = False, 0, False, False, False, 0
            return
        self.main, self.side, self.named, self.closed, self.linked, self.depth = parent.main, parent.side, parent.named, parent.closed, parent.linked or tag == "a", parent.depth + 1
        full = tag in SIDE_TAGS or tag == "header" and not self.main
        main, partly, firm = tag in MAIN_TAGS, False, full and tag != "form"
        if attributes and not attributes.isspace():
            for name, value in NAMES.findall(attributes):
                name, value = name.lower(), value.strip("\"'")
                if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and CONCEALED.search(value):
                    self.side += HIDDEN
                elif name in ("class", "id", "role") and tag not in ("html", "body"):
                    for token in value.split():
                        words = set(WORD.findall(CAMEL.sub(" ", token).lower()))
                        against = words & SIDE_WORDS or "header" in words and not self.main
                        full = full or bool(against) and words <= SIDE_WORDS | PLAIN_WORDS | {"header"}
                        partly = partly or bool(against)
                        firm = firm or bool(against) and not (words & SIDE_WORDS and words & SIDE_WORDS <= LOOSE_WORDS)
                        self.named = self.named or bool(words & MAIN_WORDS)
                    main = main or name == "role" and value.lower() in ("main", "article")
        if main and not self.closed:  # what a page-wide form or a class said around it no longer counts
            self.main, self.side = True, max(self.side, 0)
        self.loose = (full or partly) and not firm
        if number in spared:
            return
        if full:
            self.side += SIDE
            self.main = self.named = False
            self.closed = self.closed or tag != "form"
        elif partly:
            self.side += PARTLY_SIDE


def steps_between(a: _Node, b: _Node) -> int:
    """Steps from one element to another in the tree."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
        n += 1
    return n


def block_element(node: _Node) -> _Node:
    """The element that makes a block of what stands in ``node``."""
    while node.up and node.tag not in BLOCK:
        node = node.up
    return node


def blocks_of(page: str, base: int = BASE, spared: frozenset[int] = frozenset()) -> list[tuple[str, int, _Node]]:
    """(text, score in hundredths, element) of each block in page order. Elements whose
    number is ``spared`` say nothing against their blocks."""
    found: list[tuple[str, int, _Node]] = []
    stack = [_Node("", None, "", 0)]
    pieces: list[str] = []
    linked = 0
    owner = stack[0]
    numbered = 0

    def add(text: str) -> None:
        nonlocal linked, owner
        if not pieces or not text.isspace() and all(p.isspace() for p in pieces):
            owner = stack[-1]
        pieces.append(text)
        if stack[-1].linked:
            linked += len(text.strip())

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                found.append((text, score(text), owner))
            pieces.clear()
            linked = 0

    def score(text: str) -> int:
        n = len(text)
        out = base + (MAIN if owner.main else 0) + (NAMED if owner.named else 0) + max(owner.side, MOST_SIDE)
        out += min(MOST_CHARS, n * PER_100_CHARS // 100) + LINKED * min(n, linked) // n
        if text[-1] in ".!?…。！？":
            out += SENTENCE
        if not owner.main and n <= SHORT and NOTICE.search(text):
            out += SAYS_NOTICE
        tag = block_element(owner).tag
        return out + (HEADING if tag in HEADINGS else PARAGRAPH if tag in ("p", "blockquote", "pre") else 0)

    at, n = 0, len(page)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            add(html.unescape(page[at:]))
            break
        match = TAG.match(page, start)
        if match is None:  # a bare < is text
            add(html.unescape(page[at : start + 1]))
            at = start + 1
            continue
        if start > at:
            add(html.unescape(page[at:start]))
        at = match.end()
        name = match[2] or match[5]
        if not name:
            continue
        closing, name, attributes = match[1] or match[4], name.lower(), match[3] or match[6] or ""
        if closing:
            if name in BLOCK:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    del stack[k:]
                    break
                if name not in FENCE and stack[k].tag in FENCE:
                    break
            continue
        if name in RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*(?:>|\s[^>]*>|\Z)", re.IGNORECASE).search(page, at)
            if name == "head" and end is None:
                continue  # an unclosed head hides nothing
            at = end.end() if end else n
            add(" ")
            continue
        if name in BLOCK:
            flush()
        if name in VOID:
            if name in ("br", "hr", "wbr") and name != "wbr":
                add(" ")
            continue
        if name in ("td", "th"):
            add(" ")
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in CLOSES.get(name, ()) or name in BLOCK and stack[k].tag == "p":
                del stack[k:]
                break
            if stack[k].tag in FENCE:
                break
        if not attributes.endswith("/"):
            numbered += 1
            stack.append(_Node(name, stack[-1], attributes, numbered, spared))
    flush()
    if not numbered:  # no tag opened: plain text
        found = [(text, max(1, value), node) for text, value, node in found]
    return found


def min_cut(scores: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """For each node whether it is on the source (content) side of a minimum cut.

    A positive score is a capacity from the source, a negative one to the sink;
    an edge (a, b, c) has capacity c both ways. Dinic's blocking flows.
    """
    n = len(scores)
    source, sink = n, n + 1
    if not any(s > 0 for s in scores):
        return [False] * n
    if not any(s < 0 for s in scores):
        return [True] * n
    to: list[int] = []
    left: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a: int, b: int, there: int, back: int) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        left.extend((there, back))

    for i, s in enumerate(scores):
        if s > 0:
            link(source, i, s, 0)
        elif s < 0:
            link(i, sink, -s, 0)
    for a, b, c in edges:
        link(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if left[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        next_edge = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                least = min(left[e] for e in path)
                for k, e in enumerate(path):
                    left[e] -= least
                    left[e ^ 1] += least
                cut = next(k for k, e in enumerate(path) if not left[e])
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            for k in range(next_edge[a], len(out[a])):
                e = out[a][k]
                if left[e] and level[to[e]] == level[a] + 1:
                    next_edge[a] = k
                    path.append(e)
                    a = to[e]
                    break
            else:
                if a == source:
                    break
                next_edge[a] = len(out[a])
                level[a] = -1
                a = to[path.pop() ^ 1]


def edges_of(blocks: list[tuple[str, int, _Node]]) -> list[tuple[int, int, int]]:
    """Smoothness edges (a, b, capacity) of a page's blocks.

    The border of an element that speaks against its blocks counts two steps.
    """
    edges, last = [], {}
    for i, (_, _, node) in enumerate(blocks):
        parent = node
        while parent.up and parent.tag not in FENCE:
            parent = parent.up
        if i:
            before = blocks[i - 1][2]
            apart = steps_between(before, node) - 2 + 2 * (before.side != node.side)
            edges.append((i - 1, i, NEXT >> min(20, 2 * max(0, apart))))
        group = (parent.number, node.side)
        if group in last:
            edges.append((last[group], i, SIBLING))
        last[group] = i
    return edges


def holders(blocks: list[tuple[str, int, _Node]]) -> frozenset[int]:
    """Numbers of the loosely named elements that hold a paragraph and at least half
    of the prose: of the characters outside links and firm boilerplate."""
    inside: dict[int, int] = {}
    longest: dict[int, int] = {}
    every = 0
    for text, _, node in blocks:
        if node.linked:
            continue
        above, against = [], 0
        while node.up:
            if node.loose:
                above.append(node.number)
            elif node.side < node.up.side:
                against += 1
            node = node.up
        if against:
            continue
        every += len(text)
        for k in above:
            inside[k] = inside.get(k, 0) + len(text)
            longest[k] = max(longest.get(k, 0), len(text))
    return frozenset(k for k, n in inside.items() if 2 * n >= every and longest[k] >= PROSE)


def main_text(page: str | None) -> str:
    page = page or ""
    blocks = blocks_of(page)
    keep = min_cut([s for _, s, _ in blocks], edges_of(blocks))
    if blocks and not any(k and block_element(node).tag not in HEADINGS for (_, _, node), k in zip(blocks, keep, strict=True)):
        blocks = blocks_of(page, 0, holders(blocks))
        keep = min_cut([s for _, s, _ in blocks], edges_of(blocks))
    return "\n".join(text for (text, _, _), k in zip(blocks, keep, strict=True) if k)


def extract_pages(pages: DataFrame, source: str = "html", out: str = "text") -> DataFrame:
    """All columns but the html, then its main text."""
    names = [n for n in pages.columns if n not in (source, out)]
    kept = pages.select(*[F.col(f"`{n}`") for n in names], F.col(source).alias("_html"))
    schema = kept.drop("_html").withColumn(out, F.lit("")).schema

    def run(batches):
        for part in row_slices(batches, "_html"):
            texts = [main_text(p) for p in part.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(texts, pa.string())], names=[*names, out])

    return kept.mapInArrow(run, schema)
