"""HTML extraction by layout-aware rendering.

A tree builder with implied tags (open paragraphs, list items, table cells, rows and options close where the next one
begins) makes a tree of the page, with the places of the open elements by name, so that it takes time in proportion to the
page. The renderer walks it without recursion and emits all text that a browser would show: nothing of head, script, style,
template, hidden or undisplayed elements, nor of closed details but their summary; ``visibility`` is inherited, so that
a visible element shows inside a hidden one. Paragraph-like blocks stand apart by a blank line, other blocks by a line break;
list items get their marker and indentation (``MAX_INDENT`` levels at most). A table cell is rendered like a page, with its
blocks and lists, and set line by line beside the others of its row; columns are padded to a common width (up to
``MAX_PAD``), cells over several columns or rows keep their places free. Tables nested over ``MAX_NEST`` deep give a line a
block instead.

Null or empty html gives empty text. Truncated pages are rendered as far as they go. Rows are independent, so repeated
rows give equal results; null ids stay null; columns other than id and html are ignored; an empty table gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_PAD = 40
MAX_SPAN = 100
MAX_NEST = 8
MAX_INDENT = 20
#: Wider tables keep no places free for cells over several rows.
MAX_COLUMNS = 2000
TAG = re.compile(r"<(?:!--|[!?]|(/?)([A-Za-z][^\s/>]*))")
REST = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
BLANKS = re.compile(r"[ \t\n\f\r]+")
UNSHOWN_STYLE = re.compile(r"(?i)(?:^|;)\s*display\s*:\s*none")
VISIBILITY = re.compile(r"(?i)(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)")

#: Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSHOWN = frozenset("head title script style template iframe noembed noframes object audio video canvas datalist noscript".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset hr menu".split())
BLOCK = APART | frozenset("address article aside body caption center dd details dialog div dt fieldset figcaption footer form header hgroup html legend li main nav option optgroup search section summary tbody td tfoot th thead tr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
#: What leaves an open head open; any other start tag and any text ends it.
IN_HEAD = frozenset("title meta link base basefont bgsound script style template noscript noframes".split())
#: Start tag: the open elements it closes, and those beyond which it doesn't look.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "table")),
    "dt": (("dt", "dd"), ("dl", "table")),
    "dd": (("dt", "dd"), ("dl", "table")),
    "td": (("td", "th"), ("table",)),
    "th": (("td", "th"), ("table",)),
    "tr": (("tr",), ("table",)),
    "thead": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "body": (("head",), ()),
}


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: str):
        self.tag, self.attributes = tag, attributes
        self.children: list[Node | str] = []

    def attribute(self, name: str) -> str | None:
        if not self.attributes:
            return None
        for m in ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return unescape(m[2] or m[3] or m[4] or "")
        return None

    def shown(self) -> bool:
        if self.tag in UNSHOWN:
            return False
        if self.attributes:
            low = self.attributes.lower()
            if "hidden" in low and self.attribute("hidden") is not None:
                return False
            if "style" in low and UNSHOWN_STYLE.search(self.attribute("style") or ""):
                return False
        return self.tag != "dialog" or self.attribute("open") is not None

    def visible(self, inherited: bool) -> bool:
        if self.attributes and "visibility" in self.attributes.lower():
            found = VISIBILITY.findall(self.attribute("style") or "")
            if found:
                return found[-1].lower() == "visible"
        return inherited


class Tree:
    """Builds the tree of a page in one pass."""

    def __init__(self, html: str):
        self.root = Node("html", "")
        #: Open elements, and by name their places among these.
        self.stack = [self.root]
        self.places: dict[str, list[int]] = {}
        at, end, plain = 0, len(html), False
        while at < end:
            m = TAG.search(html, at)
            if not m:
                self.text(html[at:])
                break
            if m.start() > at:
                self.text(html[at : m.start()])
            if m[2] is None:
                close = "-->" if m[0] == "<!--" else ">"
                stop = html.find(close, m.end())
                at = stop + len(close) if stop >= 0 else end
                continue
            rest = None if plain else REST.match(html, m.end())
            if rest:
                at = rest.end()
            else:  # a quote that never closes: the tag ends at the next bracket
                plain = True
                stop = html.find(">", m.end())
                at = stop + 1 if stop >= 0 else end
                if stop < 0:
                    break
            name, attributes = m[2].lower(), html[m.end() : at - 1]
            if m[1]:
                self.end(name)
                continue
            self.start(name, attributes)
            if name in RAW and self.node.tag == name:
                stop = re.compile(rf"(?i)</{re.escape(name)}(?=[\s/>])").search(html, at)
                raw = html[at : stop.start()] if stop else html[at:]
                if name in ("title", "textarea"):
                    self.text(raw)
                elif name == "xmp":
                    self.node.children.append(raw)
                at = stop.start() if stop else end

    @property
    def node(self) -> Node:
        return self.stack[-1]

    def text(self, text: str) -> None:
        text = unescape(text) if "&" in text else text
        if self.node.tag == "head" and text.strip(" \t\n\f\r"):
            self.pop()
        self.node.children.append(text)

    def push(self, name: str, attributes: str) -> None:
        node = Node(name, attributes)
        self.node.children.append(node)
        if name not in VOID:
            self.places.setdefault(name, []).append(len(self.stack))
            self.stack.append(node)

    def pop(self) -> None:
        self.places[self.stack.pop().tag].pop()

    def nearest(self, names: tuple[str, ...]) -> int:
        """Place of the nearest open element of these names; 0 if there is none."""
        return max((self.places[x][-1] for x in names if self.places.get(x)), default=0)

    def close(self, names: tuple[str, ...], fence: tuple[str, ...]) -> None:
        """Close the nearest open element of these names, with all inside it, unless a fence stands nearer."""
        place = self.nearest(names)
        if place and place >= self.nearest(fence):
            while len(self.stack) > place:
                self.pop()

    def start(self, name: str, attributes: str) -> None:
        if name == "html":
            return
        if self.node.tag == "head" and name not in IN_HEAD:
            self.pop()
        if name in CLOSES_P:
            self.close(("p",), ("table", "td", "th", "button", "object", "caption"))
            if name in ("h1", "h2", "h3", "h4", "h5", "h6") and self.node.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                self.pop()
        if name in IMPLIED:
            self.close(*IMPLIED[name])
        if name in ("td", "th") and self.places.get("table") and self.node.tag in ("table", "thead", "tbody", "tfoot"):
            self.push("tr", "")
        self.push(name, attributes)

    def end(self, name: str) -> None:
        if name in VOID:
            if name == "br":
                self.push("br", "")
            return
        if self.places.get(name):
            fence = () if name in ("table", "body", "html") else ("table", "td", "th", "caption") if name not in ("td", "th", "tr", "thead", "tbody", "tfoot", "caption") else ("table",)
            self.close((name,), tuple(x for x in fence if x != name))


def walk(top: Node, visible: bool = True) -> Iterator[tuple[str, Node | str, bool]]:
    """("in", element), ("text", string) and ("out", element) of what is shown below an element, in order, each with
    whether it is visible. Send a true value after an "in" to leave the element's inside out."""
    closed = lambda x: x.tag == "details" and x.attribute("open") is None
    stack: list[tuple[Node, int, bool, bool]] = [(top, 0, visible, closed(top))]
    while stack:
        node, k, visible, shut = stack.pop()
        if k == len(node.children):
            if node is not top:
                yield "out", node, visible
            continue
        stack.append((node, k + 1, visible, shut))
        child = node.children[k]
        if isinstance(child, str):
            if visible and not shut:
                yield "text", child, True
        elif child.shown() and (not shut or child.tag == "summary"):
            own = child.visible(visible)
            if (yield "in", child, own):
                yield "skipped", child, own
            else:
                stack.append((child, 0, own, closed(child)))


def steps_of(walked: Iterator) -> Iterator[tuple[str, Node | str, bool, list]]:
    """The steps of a walk; an entry put into a step's list leaves the element's inside out."""
    step = next(walked, None)
    while step is not None:
        skip: list = []
        if step[0] != "skipped":
            yield (*step, skip)
        try:
            step = walked.send(bool(skip))
        except StopIteration:
            return


def span(cell: Node, name: str) -> int:
    raw = cell.attribute(name) or "1"
    return max(1, min(MAX_SPAN, int(raw))) if raw.isdecimal() and len(raw) < 6 else 1


def table_lines(table: Node, visible: bool, depth: int) -> list[str]:
    """Captions and stray text, then the rows: a row's cells side by side, line by line, in padded columns."""
    rows: list[list[tuple[list[str], int, int]]] = []
    before: list[str] = []
    for what, x, seen, skip in steps_of(walk(table, visible)):
        if what == "in" and x.tag in ("td", "th"):
            rows = rows or [[]]
            rows[-1].append((Renderer(depth + 1).render(x, seen).split("\n"), span(x, "colspan"), span(x, "rowspan")))
            skip.append(True)
        elif what == "in" and x.tag == "tr":
            rows.append([])
        elif what == "in" and x.tag not in ("thead", "tbody", "tfoot", "colgroup", "col"):
            if text := Renderer(depth + 1).render(x, seen):
                before += text.split("\n")
            skip.append(True)
        elif what == "text" and (text := BLANKS.sub(" ", x).strip()):
            before.append(text)
    return before + grid_lines(rows)


def grid_lines(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of rows of (lines, columns, rows) cells."""
    blank = [""]
    placed: list[list[tuple[int, int, list[str]]]] = []
    busy: dict[int, int] = {}  # columns that cells of earlier rows hold, and for how many rows yet
    widths: dict[int, int] = {}
    for row in rows:
        at, slots, fresh = 0, [], {}
        for lines, n, deep in row:
            while busy.get(at):
                slots.append((at, 1, blank))
                at += 1
            slots.append((at, n, lines))
            if n == 1:
                widths[at] = max(widths.get(at, 0), min(MAX_PAD, max(map(len, lines))))
            if deep > 1:
                fresh |= dict.fromkeys(range(at, at + n), deep - 1)
            at += n
        for column in sorted(c for c in busy if c >= at):
            if column > at:
                slots.append((at, column - at, blank))
            slots.append((column, 1, blank))
            at = column + 1
        placed.append(slots)
        busy = {c: n - 1 for c, n in busy.items() if n > 1} | fresh
        if len(busy) > MAX_COLUMNS:
            busy = {}
    out = []
    for slots in placed:
        pads = []
        for at, n, _ in slots:
            held = [widths[k] for k in range(at, at + n) if k in widths]
            pads.append(sum(held) + 3 * max(0, len(held) - 1))
        if any(x.strip() for _, _, lines in slots for x in lines):
            for k in range(max(len(lines) for _, _, lines in slots)):
                out.append(" | ".join((lines[k] if k < len(lines) else "").ljust(pad) for (_, _, lines), pad in zip(slots, pads, strict=True)).rstrip())
    return out


class Renderer:
    def __init__(self, depth: int = 0) -> None:
        self.depth = depth
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0
        self.prefix: list[str] = []
        self.marker = ""

    def brk(self, gap: int) -> None:
        """End the line; gap 1 asks for a blank line before the next one."""
        text = BLANKS.sub(" ", "".join(self.line)).strip()
        self.line = []
        if text:
            self.put(text)
        self.gap = max(self.gap, gap)

    def put(self, text: str) -> None:
        if self.lines and self.gap:
            self.lines.append("")
        self.gap = 0
        self.lines.append(("".join(self.prefix[:MAX_INDENT]) + self.marker + text).rstrip())
        self.marker = ""

    def render(self, root: Node, visible: bool = True) -> str:
        lists: list[list] = []
        pre = 1 if root.tag == "pre" else 0
        for what, x, seen, skip in steps_of(walk(root, visible)):
            if what == "text":
                if pre:
                    first, *rest = x.split("\n")
                    self.line.append(first.replace("\t", "    "))
                    for more in rest:
                        self.keep()
                        self.line.append(more.replace("\t", "    "))
                else:
                    self.line.append(x)
            elif what == "in":
                if x.tag == "br":
                    self.keep() if pre else self.brk(0)
                elif x.tag == "table" and self.depth < MAX_NEST:
                    self.brk(1)
                    for text in table_lines(x, seen, self.depth):
                        self.put(text)
                    self.brk(1)
                    skip.append(True)
                elif x.tag in BLOCK:
                    self.brk(1 if x.tag in APART and not (x.tag in ("ul", "ol", "menu") and lists) else 0)
                    if x.tag in ("ul", "ol", "menu"):
                        start = x.attribute("start") or "1"
                        lists.append([x.tag, int(start) if start.isdecimal() and len(start) < 9 else 1])
                        if len(lists) > 1:
                            self.prefix.append("  ")
                    elif x.tag == "li":
                        kind = lists[-1] if lists else ["ul", 1]
                        self.marker = f"{kind[1]}. " if kind[0] == "ol" else "- "
                        kind[1] += 1
                    elif x.tag in ("blockquote", "dd"):
                        self.prefix.append("  ")
                    elif x.tag == "pre":
                        pre += 1
            elif x.tag in BLOCK:
                if x.tag == "pre":
                    pre -= 1
                    self.keep(last=True)
                self.brk(1 if x.tag in APART and not (x.tag in ("ul", "ol", "menu") and len(lists) > 1) else 0)
                if x.tag in ("ul", "ol", "menu"):
                    lists.pop()
                    if lists:
                        self.prefix.pop()
                elif x.tag in ("blockquote", "dd"):
                    self.prefix.pop()
                elif x.tag == "li":
                    self.marker = ""
        if pre:
            self.keep(last=True)
        self.brk(0)
        return "\n".join(self.lines)

    def keep(self, last: bool = False) -> None:
        """End a line of preformatted text as it stands."""
        text = "".join(self.line).rstrip()
        self.line = []
        if text or (not last and self.lines and not self.gap):
            self.put(text)


def find(root: Node, tag: str) -> Node | None:
    stack: list[Node] = [root]
    while stack:
        node = stack.pop()
        if node.tag == tag:
            return node
        stack.extend(x for x in reversed(node.children) if isinstance(x, Node))
    return None


def extract(html: str) -> tuple[str, str]:
    """Title and visible text."""
    root = Tree(html).root
    title = find(root, "title")
    text = "".join(x for x in title.children if isinstance(x, str)) if title else ""
    return BLANKS.sub(" ", text).strip(), Renderer().render(root)


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, title, text, n_chars and n_lines of every page."""
    common.ensure_workers(pages.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("title", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_lines", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for key, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    title, text = extract(html.as_py() or "")
                    # a character reference may name a lone surrogate, which no UTF-8 text can hold
                    title, text = (x.encode("utf-8", "replace").decode() for x in (title, text))
                    yield key, title, text, len(text), text.count("\n") + 1 if text else 0

        yield from common.batches_of(rows(), schema, weigh=lambda r: r[3])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, title string, text string, n_chars long, n_lines long")
