"""Main text of web pages by minimum-cut labelling of their blocks.

1. Scan. A page is read once, from left to right, into blocks (runs of text
   between block-level tags) and the tree of elements they stand in. What an
   element hands down (main part, navigation, form, ...) is a set of marks,
   joined from the root downwards, so time and memory are linear in the page.
2. Classifier. A logistic model over a block's marks and its shape (length,
   end of sentence, share of links, heading, list item) gives the cost of
   calling it boilerplate (above 0) or content (below 0): the capacity of its
   arc from the source or to the sink. The share of the shape is bounded.
3. Edges. Blocks next to each other, and nearest blocks of one container, are
   joined by smoothness edges whose capacity falls with their distance in the
   element tree. The minimum cut (maximum flow) separates content from
   boilerplate: a short line between paragraphs follows its neighbours, and a
   long notice stands alone.

``learn`` fits the classifier. Pages that mark their parts label their own
blocks: those of an article or main element are content, those of nav, footer,
aside, header or form elements are not. Each page counts four times: as it is,
without these tags, without class names too, and as if it were made of div
elements alone, so that the shape has to tell as well. The weights stay near
given ones (a Gaussian prior), which decide where the sample shows nothing. The scale of the edges is the one whose cuts agree best
with the labels on the pages of div elements. The sample is bounded: the first
``most_pages`` keys by their hash, and of these pages of at most ``longest`` bytes.

Cases: null and empty pages give an empty text; unclosed tags, quotes, comments
and character references are read as browsers do (a tag that never ends hides
the rest); pages of any length are read whole in linear time; the cells of a row
of short cells are one block; repeated rows are independent; an empty table
gives no rows and keeps the given weights; other columns are carried, whatever
their names (one called like the added text is replaced).
"""

from __future__ import annotations

import html
import re
from collections import deque
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import shared

#: Comment, declaration or tag. Every alternative takes what it read for good, so no part of a page is read twice.
TOKEN = re.compile(
    r"<!--(?:[^-]++|-(?!->))*+(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z>][^>]*+(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"?|'[^']*+'?)?+|[\"'])*+)(>|\Z)"
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s\"'>]++)))?+", re.I)
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
#: Elements whose content is no text of the page, or belongs to a form.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "select", "button", "noframes", "xmp"}
VOID = {"br", "img", "hr", "meta", "link", "input", "wbr", "source", "area", "base", "col", "embed", "param", "track", "frame"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption", "option",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CELLS = {"td", "th"}
#: An opening tag that ends an open element: tag -> what it looks for.
ENDS = {"li": "li", "dt": "term", "dd": "term", "tr": "row", "td": "cell", "th": "cell", "tbody": "rows", "thead": "rows", "tfoot": "rows"}

AD_WORDS = set("ad ads adv advert adverts advertisement advertising adsense adbox banner banners sponsor sponsored sponsors promo promotion promoted".split())
NOTICE_WORDS = set("cookie cookies consent gdpr notice notices notification alert popup modal overlay paywall dialog alertdialog disclaimer legal copyright".split())
SIDE_WORDS = set("sidebar sidebars aside rail related recommended recommendation popular trending widget widgets tagcloud share sharing social follow newsletter subscribe subscription complementary".split())
MENU_WORDS = set("menu menus nav navbar navigation navi breadcrumb breadcrumbs crumbs footer foot header masthead topbar toolbar pagination pager paging skip contentinfo dropdown".split())
FORM_WORDS = set("signup signin login register search form feedback rating poll survey".split())
COMMENT_WORDS = set("comment comments commentlist disqus replies".split())
MILD_WORDS = set("byline meta author date timestamp caption credit credits info toc tools print tags more".split())
GOOD_WORDS = set("article content post entry story main body text maincontent articlebody prose page".split())
SPACES = re.compile(r"[^a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Marks of an element, one bit each, handed down to all inside it, with their given weights.
MARKS = {
    "main": 3.2, "nav": -8.0, "footer": -8.0, "header": -7.0, "aside": -8.0, "form": -7.0, "main_header": -0.3,
    "ad": -7.0, "notice": -7.0, "side": -7.0, "menu": -7.0, "form_class": -7.0, "comment": -8.0, "mixed": -0.5, "mild": -1.2, "good": 1.2, "hidden": -8.0, "foreign_article": -8.0,
}
BIT = {name: 1 << i for i, name in enumerate(MARKS)}
TAG_MARK = {"nav": "nav", "menu": "nav", "search": "form", "footer": "footer", "header": "header", "aside": "aside", "dialog": "aside", "form": "form", "fieldset": "form"}
WORD_MARKS = {"ad": AD_WORDS, "notice": NOTICE_WORDS, "side": SIDE_WORDS, "menu": MENU_WORDS, "form_class": FORM_WORDS, "comment": COMMENT_WORDS}
#: Marks that come from tags alone; without them a page is as if it were made of div elements.
OF_TAGS = sum(BIT[m] for m in ("main", "nav", "footer", "header", "aside", "form", "main_header"))
OTHER_PART = sum(BIT[m] for m in MARKS if m not in ("main", "main_header", "mixed", "mild", "good"))
#: Shape of a block and its given weights.
SHAPE = {"bias": -0.6, "length": 1.0, "sentence": 0.5, "links": -3.5, "rights": -1.5, "short": -0.3, "heading": 0.7, "item": -0.2, "paragraph": 0.9}
#: Features that tell of the element, not of the text; the last ones of SHAPE.
OF_ELEMENT = 3
#: Bound of the part of a cost that comes from the shape.
MOST_SHAPE = 2.5


class _Element:
    __slots__ = ("block", "bad", "cell", "depth", "heading", "holder", "holds_main", "item", "link", "marks", "para", "parent", "row", "rows", "tag", "term")

    def __init__(self, tag: str, parent: _Element | None, attributes: str):
        self.tag, self.parent = tag, parent
        self.block = tag in BLOCK
        self.holds_main = self.bad = False
        self.marks = 0
        if parent is None:
            self.depth, self.heading, self.holder = 0, False, self
            self.para = self.item = self.term = self.row = self.rows = self.cell = self.link = None
        else:
            self.depth = parent.depth + 1
            self.holder = self if self.block else parent.holder
            self.heading = tag in HEADINGS or (parent.heading and not self.block)
            # nearest open elements that a later tag may end; a block of another kind hides them
            hides = self.block and tag not in ("address", "div", "p")
            self.para = self if tag == "p" else None if self.block and tag not in HEADINGS else parent.para
            self.item = self if tag == "li" else None if hides else parent.item
            self.term = self if tag in ("dt", "dd") else None if hides else parent.term
            self.link = self if tag == "a" else None if self.block else parent.link
            table = tag == "table"
            self.row = self if tag == "tr" else None if table else parent.row
            self.cell = self if tag in CELLS else None if table or tag == "tr" else parent.cell
            self.rows = self if tag in ("tbody", "thead", "tfoot") else None if table else parent.rows
        if attributes and tag not in ("html", "body"):
            self._read(attributes)

    def _read(self, attributes: str) -> None:
        words: set[str] = set()
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            value, name = a or b or c, name.lower()
            if name in ("class", "id", "role"):
                words.update(SPACES.split(CAMEL.sub(" ", value).lower()))
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and NO_DISPLAY.search(value):
                self.marks |= BIT["hidden"]
        if not words:
            return
        good = bool(words & GOOD_WORDS)
        found = [m for m, some in WORD_MARKS.items() if words & some]
        if found and good and "comment" not in found:
            self.marks |= BIT["mixed"]
        elif found:
            self.bad = True
            for m in found:
                self.marks |= BIT[m]
        elif words & MILD_WORDS:
            self.marks |= BIT["mild"]
        if good and not found:
            self.marks |= BIT["good"]

    def settle(self) -> None:
        """Own marks and those of the parent, once it is known what the element holds."""
        above, own, tag = self.parent.marks if self.parent else 0, self.marks, self.tag
        if tag in ("article", "main"):
            own = own & BIT["hidden"] | (BIT["foreign_article"] if self.bad or above & BIT["comment"] else BIT["main"])
        elif self.holds_main:
            own &= BIT["hidden"] | BIT["good"]
        elif tag in TAG_MARK:
            own |= BIT["main_header"] if tag == "header" and above & BIT["main"] else BIT[TAG_MARK[tag]]
        self.marks = above | own


class Block:
    __slots__ = ("element", "heading", "linked", "text")

    def __init__(self, text: str, element: _Element, linked: int, heading: bool):
        self.text, self.element, self.linked, self.heading = text, element, linked, heading


def scan(page: str) -> list[Block]:
    """Blocks of a page in order; raw-text elements and comments leave nothing."""
    root = _Element("#page", None, "")
    top, open_links, found, pieces, linked = root, 0, [], [], 0
    elements = [root]
    open_tags: dict[str, int] = {}
    endless: set[str] = set()  # raw elements that no later tag closes
    at, end = 0, len(page)

    def close_block():
        nonlocal pieces, linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                found.append(Block(text, top.holder, linked, top.heading))
        pieces, linked = [], 0

    def pop_to(node: _Element):
        """Close elements up to and with this one."""
        nonlocal top, open_links
        while True:
            open_links -= top.tag == "a"
            open_tags[top.tag] -= 1
            here, top = top, top.parent
            if here is node:
                return

    def add(raw: str):
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if open_links:
            linked += len(text.strip())

    while at < end:
        match = TOKEN.search(page, at)
        if match is None:
            add(page[at:])
            break
        if match.start() > at:
            add(page[at : match.start()])
        at = match.end()
        tag = match[2]
        if tag is None or not match[4]:  # a comment, or a tag that the page's end cuts off
            continue
        tag = tag.lower()
        if match[1]:
            if not open_tags.get(tag):
                if tag == "p":
                    close_block()
                continue
            node = top
            while node.tag != tag:
                node = node.parent
            if node.block:
                close_block()
            pop_to(node)
            continue
        closed = match[3].rstrip().endswith("/")
        if tag in RAW:
            if closed and tag in ("svg", "iframe") or tag in endless:
                continue
            ending = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            if ending is None and tag in ("button", "select", "svg"):
                endless.add(tag)
                continue
            stop = page.find(">", ending.end()) if ending else -1
            at = stop + 1 if stop >= 0 else end
            pieces.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                close_block()
            elif tag != "wbr":
                pieces.append(" ")
            continue
        if tag in BLOCK:
            close_block()
            if top.para is not None:
                pop_to(top.para)  # an open paragraph ends here, with what stands inside it
            ended = ENDS.get(tag)
            if ended and (node := getattr(top, {"li": "item"}.get(ended, ended))) is not None:
                pop_to(node)
        elif closed:
            continue
        if tag == "a" and open_links and top.link is not None:
            pop_to(top.link)
        top = _Element(tag, top, match[3])
        elements.append(top)
        open_tags[tag] = open_tags.get(tag, 0) + 1
        if tag == "a":
            open_links += 1
        elif tag in ("article", "main") and not top.bad:
            node = top.parent
            while node is not None and not node.holds_main and not node.marks & BIT["comment"]:
                node.holds_main = True
                node = node.parent
    close_block()
    for element in elements:
        element.settle()
    return _rows(found)


def _rows(blocks: list[Block], longest: int = 200) -> list[Block]:
    """Cells of one table row become one block, if all are short."""
    out: list[Block] = []
    at = 0
    while at < len(blocks):
        row = blocks[at].element.parent if blocks[at].element.tag in CELLS else None
        stop = at + 1
        while row is not None and stop < len(blocks) and blocks[stop].element.tag in CELLS and blocks[stop].element.parent is row:
            stop += 1
        some = blocks[at:stop]
        if len(some) > 1 and all(len(b.text) <= longest for b in some):
            out.append(Block(" ".join(b.text for b in some), some[0].element, sum(b.linked for b in some), False))
        else:
            out += some
        at = stop
    return out


def shape(block: Block) -> tuple[float, ...]:
    """Features of a block, in the order of SHAPE."""
    t, tag = block.text, block.element.tag
    n = len(t)
    ends = t[-1] in ".!?:;\"'”»…。)"
    return (
        1.0, min(n / 120, 1.6), float(ends), max(0.0, block.linked / n - 0.3), float(t[0] in "©®" or n < 200 and "©" in t), float(n < 25 and not ends),
        float(block.heading), float(tag in ("li", "dd", "dt", "td", "th")), float(tag in ("p", "blockquote", "pre")),
    )


@dataclass
class Model:
    """Weights of the marks and of the shape, and the scale of the edges."""

    marks: tuple[float, ...] = tuple(MARKS.values())
    shape: tuple[float, ...] = tuple(SHAPE.values())
    scale: float = 1.0

    def costs(self, blocks: list[Block], seen: int = -1, elements: bool = True) -> list[float]:
        """Cost of calling each block boilerplate; ``seen`` masks the marks that count, ``elements`` tells if those of SHAPE do."""
        known: dict[int, float] = {}
        weights = self.shape if elements else self.shape[:-OF_ELEMENT]
        out = []
        for b in blocks:
            marks = b.element.marks & seen
            if marks not in known:
                known[marks] = sum(w for i, w in enumerate(self.marks) if marks >> i & 1)
            looks = sum(w * x for w, x in zip(weights, shape(b), strict=False))
            out.append(known[marks] + max(-MOST_SHAPE, min(MOST_SHAPE, looks)))
        return out

    def labels(self, blocks: list[Block], seen: int = -1, elements: bool = True) -> list[bool]:
        """True for content."""
        return minimum_cut(self.costs(blocks, seen, elements), [(i, j, self.scale * c) for i, j, c in edges(blocks)]) if blocks else []


GIVEN = Model()


def cost(block: Block) -> float:
    """Cost under the given weights."""
    return GIVEN.costs([block])[0]


def _distance(a: _Element, b: _Element) -> int:
    """Steps between two elements of the tree; over all neighbours no more than the tags of the page."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def edges(blocks: list[Block], adjacent: float = 2.4, near: float = 1.2) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours on the page, and nearest blocks of one container. Parts with other marks are hardly joined."""
    out: list[tuple[int, int, float]] = []
    last_of: dict[int, int] = {}
    for i, block in enumerate(blocks):
        if i:
            out.append((i - 1, i, adjacent / (1 + _distance(blocks[i - 1].element, block.element))))
        container = id(block.element.parent or block.element)
        before = last_of.get(container)
        if before is not None:
            out.append((before, i, near / (1 + _distance(blocks[before].element, block.element))))
        last_of[container] = i
    return out


def minimum_cut(costs: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """True for blocks on the source's (content) side of a minimum cut."""
    n = len(costs)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i, j, c in links:
        near[i].append((j, c))
        near[j].append((i, c))
    left, label = list(costs), [None] * n
    pull = [sum(c for _, c in some) for some in near]
    ready = deque(i for i in range(n) if abs(left[i]) >= pull[i])
    while ready:  # a node whose terminal outweighs its open edges is on that side in some minimum cut
        i = ready.popleft()
        if label[i] is not None:
            continue
        label[i] = left[i] > 0
        for j, c in near[i]:
            if label[j] is None:
                left[j] += c if label[i] else -c
                pull[j] -= c
                if abs(left[j]) >= pull[j] - 1e-12:
                    ready.append(j)
    open_ = [i for i in range(n) if label[i] is None]
    if open_:
        number = {i: k for k, i in enumerate(open_)}
        reached = _flow(len(open_), [left[i] for i in open_], [(number[i], number[j], c) for i, j, c in links if label[i] is None and label[j] is None])
        for i in open_:
            label[i] = reached[number[i]]
    return label


def _flow(n: int, costs: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Dinic's maximum flow, begun at the terminal with fewer arcs; True for nodes on the source's side."""
    if sum(c > 0 for c in costs) > sum(c < 0 for c in costs):
        return [not x for x in _flow(n, [-c for c in costs], links)]
    source, sink = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def arc(a: int, b: int, there: float, back: float) -> None:
        graph[a].append(len(to))
        graph[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for i, c in enumerate(costs):
        if c > 0:
            arc(source, i, c, 0.0)
        elif c < 0:
            arc(i, sink, -c, 0.0)
    for i, j, c in links:
        arc(i, j, c, c)
    tiny = 1e-12
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        line = deque([source])
        while line:
            a = line.popleft()
            if 0 <= level[sink] <= level[a]:
                break  # what lies farther is on no shortest path
            for e in graph[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    line.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        tried = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                path, a = [], source
                continue
            while tried[a] < len(graph[a]):
                e = graph[a][tried[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                tried[a] += 1
            if tried[a] < len(graph[a]):
                path.append(graph[a][tried[a]])
                a = to[path[-1]]
            elif path:
                e = path.pop()
                a = to[e ^ 1]
                tried[a] += 1
            else:
                break


def main_text(page: str | None, model: Model = GIVEN) -> str:
    """Content blocks in page order, joined by an empty line."""
    blocks = scan(page or "")
    return "\n\n".join(b.text for b, kept in zip(blocks, model.labels(blocks), strict=True) if kept)


# ---- learning -------------------------------------------------------------------------------------------------------------

#: What is seen of a page in each version: (marks, features of elements).
VERSIONS = ((-1, True), (~OF_TAGS, True), (0, True), (0, False))


def own_label(block: Block) -> int:
    """1 content, 0 boilerplate by the page's own tags, -1 unknown."""
    marks = block.element.marks
    if marks & OTHER_PART:
        return 0
    return 1 if marks & BIT["main"] else -1


def fit(pages: list[str], hold: float = 60.0, rounds: int = 12, scales: tuple[float, ...] = (1.0, 0.5, 0.75, 1.5, 2.0)) -> Model:
    """Model of labelled pages; ``hold`` is the strength of the prior, in blocks."""
    scanned = [s for s in map(scan, pages) if s]
    given = np.array([*GIVEN.marks, *GIVEN.shape])
    rows, labels = [], []
    for blocks in scanned:
        some = [(own_label(b), b) for b in blocks]
        share = 1 / len(VERSIONS) / max(1, sum(y >= 0 for y, _ in some))  # a long page counts as a short one
        for y, b in some:
            if y >= 0:
                looks = shape(b)
                bare = (*looks[:-OF_ELEMENT], *[0.0] * OF_ELEMENT)
                for seen, elements in VERSIONS:
                    rows.append((*(float(b.element.marks & seen & BIT[m] > 0) for m in MARKS), *(looks if elements else bare), share))
                    labels.append(float(y))
    if len(set(labels)) < 2:
        return GIVEN
    x, y = np.array(rows), np.array(labels)
    x, share = x[:, :-1], x[:, -1] * 20  # a page weighs as much as twenty blocks
    w = given.copy()
    for _ in range(rounds):  # Newton steps of the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (y - p)) - hold * (w - given)
        bend = (x * (share * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + hold * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    n = len(MARKS)
    best, score = GIVEN, -1.0
    for scale in scales:
        model = Model(tuple(w[:n].tolist()), tuple(w[n:].tolist()), scale)
        right = total = 0
        for blocks in scanned[:200]:
            for y_, kept in zip(map(own_label, blocks), model.labels(blocks, 0, False), strict=True):
                right += y_ == int(kept)
                total += y_ >= 0
        if right > score * total:
            best, score = model, right / max(1, total)
    return best


def learn(pages: DataFrame, keys: list[str], html_name: str = "html", most_pages: int = 400, longest: int = 50_000) -> Model:
    """Fit on a bounded sample: the first pages by a hash of their keys, with markup of at most ``longest`` bytes."""
    key = F.xxhash64(*map(shared.column, keys))
    chosen = pages.select(key.alias("h")).distinct().orderBy("h").limit(most_pages)  # reads no page
    some = pages.select(key.alias("h"), shared.column(html_name).cast("string").alias("page")).join(F.broadcast(chosen), "h")  # most_pages keys
    once = some.where(F.octet_length("page") <= longest).groupBy("h").agg(F.min("page").alias("page"))
    return fit([r["page"] for r in once.orderBy("h").collect()])


def _extract(model: Model):
    def worker(columns: list[str], html_name: str):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                texts = [main_text(x.decode("utf-8", "replace") if x is not None else None, model) for x in batch[html_name].cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(texts, pa.string())], [*columns, "out0"])

        return run

    return worker


def extract(df: DataFrame, keep: list[str], html_name: str = "html", out: str = "text", model: Model = GIVEN) -> DataFrame:
    """Columns ``keep`` and the main text of every page; a column of the text's name is replaced."""
    shared.bound_batches(df.sparkSession)
    return shared.map_texts(df, [c for c in keep if c != out], html_name, _extract(model), **{out: "string"})
