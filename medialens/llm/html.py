"""Layout-aware text of HTML pages: a tree builder with implied tags, then a renderer.

The builder closes and opens the tags that HTML lets authors leave out. The renderer walks the
tree with an explicit stack (any depth), leaves out what a browser would not show, and keeps
the layout: blank lines around paragraphs, bullets and numbers, aligned table columns.
"""

from __future__ import annotations

import html as entities
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialens.llm.runtime import col, map_arrow
from medialens.llm.words import blocks

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
PLAIN = frozenset("title textarea".split())
UNSEEN = frozenset("head script style template noscript iframe object audio video canvas datalist noembed noframes title meta link base param source track area map rp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu table blockquote pre figure fieldset".split())
BLOCKS = SPACED | frozenset("html body div section article header footer nav main aside address form li dt dd tr td th thead tbody tfoot caption hr figcaption legend details summary dialog option optgroup center hgroup search".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
SCOPES = frozenset("html body table td th caption button object template".split())
TABLE_PARTS = frozenset("td th caption tr thead tbody tfoot".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of the first kind ends open elements of the second, up to one of the third.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}),
    "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
}

#: A column is padded to its widest cell with which it makes at most so many characters for each one of its cells, or its share of so many in all; longer cells stand out.
MAX_PADDING, MIN_PADDING = 8, 2000
#: Tables in tables deeper than this are read as blocks; indents stop at so many characters.
MAX_GRIDS, MAX_INDENT = 64, 64
#: Cells over several columns reach as far as this one.
MAX_COLUMNS = 200
#: Characters of pages that are rendered before their texts are sent on.
BLOCK_CHARS = 2_000_000

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_OPENING = re.compile(r"<(?=[!?/a-zA-Z])")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_BLANK = re.compile(r"[ \t\n\r\f]+")
_STYLE_HIDES = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_STYLE_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(\w+)", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(text: str) -> dict[str, str]:
    if not text or text.isspace():
        return {}
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        out.setdefault(m[1].lower(), entities.unescape(value) if "&" in value else value)
    return out


class _Places:
    """Where a character stands in a page: the next place from a given one on."""

    def __init__(self, page: str, wanted: str):
        self.at = [m.start() for m in re.finditer(wanted, page)]
        self.n = 0

    def next(self, at: int) -> int:
        """-1 if there is none. Mostly asked for places close to the last one."""
        k, places = self.n, self.at
        if k and places[k - 1] >= at:
            k = bisect_left(places, at, 0, k)
        elif len(places) - k > 8 and places[k + 8] < at:
            k = bisect_left(places, at, k + 8)
        else:
            while k < len(places) and places[k] < at:
                k += 1
        self.n = k
        return places[k] if k < len(places) else -1


class Tags:
    """Finds the ends of tags. A tag ends at the first `>` outside quotes; one without such an end is text.

    Every place of a page is looked at a bounded number of times, however many tags lack an end: what is found on the
    way to none is kept.
    """

    def __init__(self, page: str):
        self.stops = _Places(page, "[>\"']")
        self.quotes = {q: _Places(page, q) for q in "\"'"}
        self.page, self.lost = page, set()

    def end(self, at: int) -> int:
        """The place of the `>` that ends a tag of which `at` is outside quotes; -1 if none does."""
        seen = []
        while True:
            stop = self.stops.next(at)
            if stop < 0 or stop in self.lost:
                break
            if (c := self.page[stop]) == ">":
                return stop
            seen.append(stop)
            close = self.quotes[c].next(stop + 1)
            if close < 0:
                break
            at = close + 1
        self.lost.update(seen)
        return -1


class Stack:
    """Open elements, and for each tag the places of its open ones, so that an end tag finds its element at once."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def pop(self) -> None:
        self.places[self.nodes.pop().tag].pop()

    def inner(self, tags) -> int:
        """Place of the innermost open element of tags; 0 if there is none."""
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=0)

    def end(self, tags, scopes) -> None:
        """Ends the innermost open element of tags that no scope hides, with all inside."""
        k = self.inner(tags)
        if k and self.inner(scopes) <= k:
            while len(self.nodes) > k:
                self.pop()


def build(page: str) -> Node:
    """Tree of a page; unclosed elements end with the page, stray end tags are left out."""
    root = Node("html", {})
    stack, tags, gts = Stack(root), Tags(page), _Places(page, ">")
    nodes = stack.nodes
    closings: dict[str, _Places] = {}
    at, n = 0, len(page)

    def text(piece: str) -> None:
        if piece:
            nodes[-1].children.append(entities.unescape(piece) if "&" in piece else piece)

    begun = 0  # of the text that is not yet put into the tree
    while at < n:
        opening = _OPENING.search(page, at)
        if opening is None:
            break
        start = opening.start()
        following = page[start + 1]
        if following in "!?":
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                end = n if end < 0 else end + 3
            else:
                end = gts.next(start) + 1
            if not end:
                at = start + 1
                continue
            text(page[begun:start])
            begun = at = end
            continue
        m = _NAME.match(page, start)
        end = tags.end(m.end()) if m else -1
        if end < 0:
            at = start + 1
            continue
        text(page[begun:start])
        begun = at = end + 1
        tag, attributes = m[2].lower(), page[m.end() : end]
        if m[1]:
            if tag == "p" and not stack.inner(("p",)):
                nodes[-1].children.append(Node("p", {}))
            elif tag in HEADINGS:
                stack.end(HEADINGS, SCOPES)
            elif tag not in ("html", "body"):
                stack.end((tag,), () if tag == "table" else ("table",) if tag in TABLE_PARTS else ("td", "th", "caption"))
            continue
        if tag in ("html", "body"):
            for k, v in _attributes(attributes).items():
                root.attrs.setdefault(k, v)
            if tag == "body":
                stack.end(("head",), ())
            continue
        if tag in CLOSES_P:
            stack.end(("p",), SCOPES)
        if tag in BLOCKS and nodes[-1].tag == "head":
            stack.pop()
        if tag in HEADINGS and nodes[-1].tag in HEADINGS:
            stack.pop()
        if (rule := ENDS.get(tag)) is not None:
            for _ in range(3 if tag in ("thead", "tbody", "tfoot") else 2 if tag == "tr" else 1):
                stack.end(*rule)
            if tag in ("td", "th") and nodes[-1].tag in ("table", "thead", "tbody", "tfoot"):
                row = Node("tr", {})
                nodes[-1].children.append(row)
                stack.push(row)
        node = Node(tag, _attributes(attributes))
        nodes[-1].children.append(node)
        if tag in RAW or tag in PLAIN:
            if tag not in closings:
                closings[tag] = _Places(page, rf"(?i)</{re.escape(tag)}(?=[\s/>])")
            close = closings[tag].next(at)
            last = gts.next(close) if close >= 0 else -1
            inner = page[at : close if last >= 0 else n]
            if tag in PLAIN:
                node.children.append(entities.unescape(inner))
            begun = at = last + 1 if last >= 0 else n
        elif tag not in VOID and not (attributes.endswith("/") and tag in ("svg", "path", "g")):
            stack.push(node)
    text(page[begun:])
    return root


def width(s: str) -> int:
    """Columns of a text: two for wide characters, none for combining ones."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class Flow:
    """Lines of one block container."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = 0
        self.indent: list[str] = []
        self.mark = ""
        self.space = False

    def words(self, s: str) -> None:
        if not s:
            return
        s = _BLANK.sub(" ", s)
        if s == " ":
            self.space = bool(self.now)
            return
        if (self.space or s[0] == " ") and self.now:
            self.now.append(" ")
        self.now.append(s.strip(" "))
        self.space = s[-1] == " "

    def line(self, s: str) -> None:
        if self.gap > 1 and self.lines:
            self.lines.append("")
        self.gap = 0
        head = "".join(self.indent)[-MAX_INDENT:]
        if self.mark:
            head, self.mark = head[: len(head) - len(self.mark)] + self.mark, ""
        self.lines.append((head + s).rstrip(" "))

    def flush(self) -> None:
        if self.now:
            s = "".join(self.now)
            self.now = []
            self.line(s)
        self.space = False

    def rest(self, gap: int) -> None:
        self.flush()
        self.gap = max(self.gap, gap)

    def kept(self, s: str) -> None:
        """Text of <pre>: its lines as they are."""
        first, *more = s.split("\n")
        if first:
            self.now.append(first)
        for x in more:
            self.line("".join(self.now))
            self.now = [x] if x else []

    def text(self) -> str:
        self.flush()
        return "\n".join(self.lines).strip("\n")


class Grid:
    """Rows of a table's cells."""

    def __init__(self):
        self.rows: list[list[tuple[str, int, int]]] = []
        self.captions: list[str] = []

    def lay_out(self) -> list[str]:
        """Lines with columns aligned; two spaces between columns. A cell over several columns or
        rows stands in the first of them; columns after MAX_COLUMNS are taken by cells one by one. Where full alignment would make more than MIN_PADDING characters and MAX_PADDING times
        those of the cells, each column is as wide as its widest cell that it can afford: the line of a longer cell goes on after it, and a column that can afford none is not aligned."""
        placed: list[dict[int, list[str]]] = []
        until: dict[int, int] = {}  # the last row that a cell over several rows takes a column of
        for n, row in enumerate(self.rows):
            at, cells = 0, {}
            for body, across, down in row:
                while until.get(at, -1) >= n:
                    at += 1
                cells[at] = body.split("\n")
                beyond = max(at + 1, min(at + across, MAX_COLUMNS))
                if down > 1:
                    until.update(dict.fromkeys(range(at, beyond), n + down - 1))
                at = beyond
            placed.append(cells)
        widths: dict[int, int] = {}
        own = size = 0
        for cells in placed:
            for c, lines in cells.items():
                widths[c] = max([widths.get(c, 0), *map(width, lines)])
                own += sum(len(x) - x.count(" ") for x in lines)
        shown = [c for c in sorted(widths) if widths[c]]
        edges = [0, *accumulate(widths[c] + 2 for c in shown)]
        out = [x for caption in self.captions for x in caption.split("\n")]
        for cells in placed:
            size += edges[bisect_right(shown, max(cells, default=-1))] * max((len(x) for x in cells.values()), default=0)
        if size > MAX_PADDING * own + MIN_PADDING:
            widths = self._affordable(placed, shown)
            edges = [0, *accumulate(widths[c] + 2 if widths[c] else 0 for c in shown)]
        start = dict(zip(shown, edges, strict=False))
        for cells in placed:
            filled = [(c, cells[c]) for c in sorted(cells) if c in start]
            for k in range(max((len(x) for x in cells.values()), default=0)):
                pieces, at = [], 0
                for c, lines in filled:
                    if k < len(lines) and lines[k]:
                        gap = max(start[c] - at, 2 if at else 0)
                        pieces += [" " * gap, lines[k]]
                        at += gap + width(lines[k])
                line = "".join(pieces).rstrip(" ")
                if line or filled:
                    out.append(line)
        return out

    @staticmethod
    def _affordable(placed: list[dict[int, list[str]]], shown: list[int]) -> dict[int, int]:
        """For each column the width of its widest cell that it can afford, 0 for none."""
        place = {c: k for k, c in enumerate(shown)}
        sizes: list[list[int]] = [[] for _ in shown]
        text, ends = [0] * len(shown), [0] * (len(shown) + 1)
        for cells in placed:
            ends[bisect_right(shown, max(cells, default=-1))] += max((len(x) for x in cells.values()), default=0)
            for c, lines in cells.items():
                if c in place:
                    sizes[place[c]] += [n for n in map(width, lines) if n]
                    text[place[c]] += sum(len(x) - x.count(" ") for x in lines)
        reaching = list(accumulate(reversed(ends)))[::-1][1:]  # lines that go up to a column or beyond
        most = [(MAX_PADDING * t + MIN_PADDING / len(shown)) / max(1, n) - 2 for t, n in zip(text, reaching, strict=True)]
        return {c: max((n for n in sizes[k] if n <= most[k]), default=0) for k, c in enumerate(shown)}


def _span(value: str | None, most: int) -> int:
    return min(most, max(1, int(value))) if value and value.isascii() and value.isdigit() else 1


def render(root: Node) -> str:
    """All visible text with its layout."""
    flows, grids, lists, pre = [Flow()], [], [], 0
    plain: list[bool] = []  # for each open table whether it is too deep for a grid
    todo: list[tuple[object, bool, bool]] = [(root, False, True)]
    while todo:
        node, leaving, seen = todo.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if not seen:
                pass
            elif grids and grids[-1][1] == len(flows):  # between cells: browsers show it before the table
                if not node.isspace():
                    grids[-1][0].captions.append(_BLANK.sub(" ", node).strip(" "))
            elif pre:
                flow.kept(node)
            else:
                flow.words(node)
            continue
        tag = node.tag
        gap = 2 if tag in SPACED else 1 if tag in BLOCKS else 0
        if leaving:
            if tag == "table" and plain.pop():
                flow.rest(2)
            elif tag == "table":
                lines = grids.pop()[0].lay_out()
                for line in lines:
                    flow.line(line)
                flow.gap = max(flow.gap, 2)
            elif tag in ("td", "th", "caption") and len(flows) > 1 and grids and grids[-1][1] == len(flows) - 1:
                body = flows.pop().text()
                if tag == "caption":
                    grids[-1][0].captions.append(body)
                else:
                    if not grids[-1][0].rows:
                        grids[-1][0].rows.append([])
                    grids[-1][0].rows[-1].append((body, _span(node.attrs.get("colspan"), 1000), _span(node.attrs.get("rowspan"), 65534)))
            else:
                if tag == "li" and flow.indent:
                    flow.flush()
                    if flow.mark:
                        flow.line("")
                    flow.indent.pop()
                elif tag in ("ul", "ol", "menu"):
                    flow.flush()
                    lists.pop()
                elif tag in ("blockquote", "dd"):
                    flow.flush()
                    flow.indent.pop()
                elif tag == "pre":
                    pre -= 1
                if gap:
                    flow.rest(1 if tag in ("ul", "ol", "menu") and lists else gap)
            continue
        if tag in UNSEEN or "hidden" in node.attrs:
            continue
        style = node.attrs.get("style")
        if style:
            if _STYLE_HIDES.search(style):
                continue
            if found := _STYLE_VISIBILITY.search(style):
                seen = found[1].lower() not in ("hidden", "collapse")
        if tag == "dialog" and "open" not in node.attrs:
            continue
        if tag == "br":
            if seen:
                if flow.now:
                    flow.flush()
                elif flow.lines:
                    flow.gap = max(flow.gap, 2)
            continue
        if tag in VOID:
            if tag == "hr":
                flow.rest(2)
            continue
        children = node.children
        if tag == "details" and "open" not in node.attrs:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        todo.append((node, True, seen))
        if tag == "table":
            flow.rest(2)
            plain.append(len(grids) >= MAX_GRIDS)
            if not plain[-1]:
                grids.append((Grid(), len(flows)))
        elif tag == "tr" and grids and grids[-1][1] == len(flows):
            grids[-1][0].rows.append([])
        elif tag in ("td", "th", "caption") and grids and grids[-1][1] == len(flows):
            flows.append(Flow())
        else:
            if gap:
                flow.rest(1 if tag in ("ul", "ol", "menu") and lists else gap)
            if tag in ("ul", "ol", "menu"):
                start = node.attrs.get("start", "")
                lists.append([tag == "ol", int(start) - 1 if start.isascii() and start.isdigit() else 0])
            elif tag == "li":
                mark = "- "
                if lists and lists[-1][0]:
                    lists[-1][1] += 1
                    mark = f"{lists[-1][1]}. "
                flow.indent.append(" " * len(mark))
                flow.mark = mark
            elif tag in ("blockquote", "dd"):
                flow.indent.append("  ")
            elif tag == "pre":
                pre += 1
        todo.extend((c, False, seen) for c in reversed(children))
    return flows[0].text()


def extract(page: str | None) -> str:
    """Visible text of a page; '' for null."""
    return render(build(page)) if page else ""


def extract_pages(df: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, text, n_chars, n_lines of each row of df (repeated rows too).

    Null or empty pages give an empty text; pages of any length or nesting are rendered whole, in steps that grow with
    their length alone, into a text of bounded size for each character; an empty table gives an empty result; repeated rows
    are rendered each; other columns do not matter. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 1, BLOCK_CHARS):
                texts = [extract(p) for p in part.column(1).to_pylist()]
                counts = [pa.array(x, pa.int64()) for x in (list(map(len, texts)), [t.count("\n") + 1 if t else 0 for t in texts])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), *counts], names=["page_id", "text", "n_chars", "n_lines"])

    rows = df.select(col(page_id).alias("page_id"), F.coalesce(col(html), F.lit("")).alias("html"))
    return map_arrow(rows, run, f"page_id {rows.dtypes[0][1]}, text string, n_chars bigint, n_lines bigint")
