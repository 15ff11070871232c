"""Layout-aware rendering of HTML as plain text.

A tokenizer and a tree builder make a tree: void elements, raw-text elements, implied
end tags (p, li, dt, dd, option, table parts, headings) and implied table parts follow
the HTML standard; formatting elements carry no layout and get a node only if something
may hide them. A renderer then writes all text that a reader would see: blocks on lines
of their own with blank lines where margins stand, lists with bullets or numbers and
indentation, tables with aligned columns, preformatted text as it is. Comments, heads,
scripts, closed details, elements with ``hidden``, ``display:none`` or
``visibility:hidden`` (by style attribute or by a style sheet's plain tag, class or id
selectors) are not seen.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import re
import unicodedata
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridgraph.llm.common import as_bytes, bound_batches, sliced, table

# Fixed values of the HTML standard: sets of element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
RAW_WITH_ENTITIES = frozenset("textarea title".split())
UNSEEN = frozenset("head title script style template noscript iframe noembed noframes canvas audio video object datalist meta link param source track area base rp annotation annotation-xml".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt main menu nav ol p pre search section summary table ul xmp".split())
BLOCK = CLOSES_P | frozenset("html body tr tbody thead tfoot caption optgroup option legend select textarea".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table figure hr menu dir xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FORMATTING = frozenset("a abbr b bdi bdo big cite code em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var del dfn data".split())
OVERLAPPING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
SECTIONS = frozenset("tbody thead tfoot".split())
CELLS = frozenset("td th".split())
TABLE_PARTS = SECTIONS | CELLS | frozenset("caption colgroup col tr".split())
FOREIGN = frozenset(("svg", "math"))
SVG_UNSEEN = frozenset("defs desc metadata symbol clippath mask marker pattern".split())
STACKED = frozenset("mfrac mroot mover munder munderover mtable mtr".split())
BETWEEN = SECTIONS | frozenset("table tr".split())

#: A tag up to its end: quotes hold a value only behind an equals sign.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?=[^\s\"'])|\Z))*+)")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_COMMENT_END = re.compile(r"--!?>")
_BRACE = re.compile(r"([{}])")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_LIKE_NUMBER = re.compile(r"-?\d{1,9}")
#: Elements that end tags of plain inline elements do not reach over.
SPECIAL = BLOCK | CELLS | frozenset("button object template table".split())
#: Fixed values of the standard: the greatest spans of a cell.
COLSPAN, ROWSPAN = 1000, 65534
#: Indentation and the alignment of cells reach up to so many columns; tables in so many
#: others have their cells as blocks. This is layout alone: all text stays, however deep.
INDENT, ALIGNED, TABLES = 80, 1000, 24


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        out.setdefault(m[1].lower(), unescape(value) if "&" in value else value)
    return out


class Builder:
    """The tree of a page. Every step takes time that does not depend on the depth: the
    places of open elements are kept by tag."""

    def __init__(self, page: str):
        self.root = Node("html", {})
        self.stack = [self.root]
        self.places: dict[str, list[int]] = {}
        self.sheets: list[str] = []
        at, done, n = 0, 0, len(page)
        while (at := page.find("<", at)) >= 0:
            after = page[at + 1 : at + 2]
            if after == "!" or after == "?" or (after == "/" and not _letter(page[at + 2 : at + 3])):
                if done < at:
                    self.text(page[done:at])
                at = done = self.passed(page, at)
                continue
            if after != "/" and not _letter(after):
                at += 1  # a plain character
                continue
            m = _TAG.match(page, at)
            if done < at:
                self.text(page[done:at])
            end = m.end()
            if end < n and page[end] == "=":  # a quote that nothing closes
                end = page.find(">", end)
            if not 0 <= end < n:
                at = done = n  # the page ends within a tag
                break
            name, raw = m[2].lower(), page[m.start(3) : end]
            at = done = end + 1
            if m[1]:
                self.end(name)
                continue
            self.start(name, raw)
            if name in RAW or name in RAW_WITH_ENTITIES:
                at = done = self.raw(page, name, at)
            elif name == "plaintext":
                self.place(page[at:], False)
                done = n
                break
        if done < n:
            self.text(page[done:])

    @staticmethod
    def passed(page: str, at: int) -> int:
        """Where a comment, or what reads as one, ends."""
        if not page.startswith("<!--", at):
            end = page.find(">", at)
            return len(page) if end < 0 else end + 1
        for short in (">", "->"):
            if page.startswith(short, at + 4):
                return at + 4 + len(short)
        m = _COMMENT_END.search(page, at + 4)
        return m.end() if m else len(page)

    def raw(self, page: str, name: str, at: int) -> int:
        """Takes in an element of raw text; where it ends."""
        m = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(page, at)
        close = m.start() if m else len(page)
        if name == "style":
            self.sheets.append(page[at:close])
        elif name == "xmp":
            self.place(page[at:close], False)
        elif name in RAW_WITH_ENTITIES and close > at:
            self.place(unescape(page[at:close]), False)
        end = page.find(">", close)
        self.end(name)
        return len(page) if end < 0 else end + 1

    def text(self, text: str) -> None:
        text = unescape(text) if "&" in text else text
        self.place(text, not text.strip())

    def place(self, child: Node | str, in_table: bool) -> None:
        """Adds to the open element; between table parts, what is none stands before the
        table."""
        if in_table or self.stack[-1].tag not in BETWEEN:
            self.stack[-1].children.append(child)
            return
        at = self.places["table"][-1]
        before = self.stack[at - 1].children
        before.insert(next((k for k in range(len(before) - 1, -1, -1) if before[k] is self.stack[at]), len(before)), child)

    def push(self, tag: str, attrs: dict[str, str] | None = None) -> None:
        node = Node(tag, attrs or {})
        self.place(node, tag in TABLE_PARTS or tag in UNSEEN)
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(node)

    def pop_to(self, size: int) -> None:
        while len(self.stack) > size:
            self.places[self.stack.pop().tag].pop()

    def nearest(self, tags: Iterable[str]) -> int:
        """The place of the nearest open element of ``tags``; 0 if there is none."""
        places = self.places
        return max([places[t][-1] for t in tags if places.get(t)], default=0)

    def close(self, tags: Iterable[str], within: Iterable[str]) -> None:
        """Closes the nearest open element of ``tags``, unless one of ``within`` is nearer."""
        if (at := self.nearest(tags)) and at > self.nearest(within):
            self.pop_to(at)

    def start(self, tag: str, raw: str) -> None:
        if tag in ("html", "body"):
            self.root.attrs |= {k: v for k, v in _attributes(raw).items() if k not in self.root.attrs}
            if tag == "body":
                self.close(("head",), ())
            return
        foreign = self.nearest(("svg", "math", "foreignobject")) if tag in FOREIGN or self.places.keys() & FOREIGN else 0
        if tag in FOREIGN or (foreign and self.stack[foreign].tag in FOREIGN):
            if raw.rstrip().endswith("/"):
                self.place(Node(tag, _attributes(raw)), False)
                return
            if tag in CLOSES_P:
                self.pop_to(foreign)  # ends the drawing or formula
        if tag in CLOSES_P:
            if self.places.get("p"):
                self.close(("p",), ("table", "td", "th", "caption", "button", "object", "template"))
            if self.stack[-1].tag == "head":
                self.pop_to(len(self.stack) - 1)
        if tag == "table" and self.stack[-1].tag in BETWEEN:
            self.close(("table",), ())
        if tag == "li":
            self.close(("li",), ("ul", "ol", "menu", "dir", "table", "td", "th"))
        elif tag in ("dt", "dd"):
            self.close(("dt", "dd"), ("dl", "table", "td", "th"))
        elif tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.pop_to(len(self.stack) - 1)
        elif tag in ("option", "optgroup"):
            self.close(("option",), ("select", "datalist"))
            if tag == "optgroup":
                self.close(("optgroup",), ("select", "datalist"))
        elif tag in CELLS or tag == "tr" or tag in SECTIONS or tag in ("caption", "colgroup", "col"):
            if not self.places.get("table"):
                return
            self.close(("td", "th", "caption"), ("table",))
            if tag not in CELLS:
                self.close(("tr",), ("table",))
            if tag not in CELLS and tag != "tr":
                self.close(SECTIONS, ("table",))
            self.close(("colgroup",), ("table",))
            self.pop_to(1 + self.nearest(("table", "tr", *SECTIONS)))
            if tag in CELLS and self.stack[-1].tag != "tr":
                if self.stack[-1].tag == "table":
                    self.push("tbody")
                self.push("tr")
            elif tag == "tr" and self.stack[-1].tag == "table":
                self.push("tbody")
        attrs = _attributes(raw) if raw.strip(" /\n\t") else {}
        if tag in VOID:
            self.place(Node(tag, attrs), False)
        elif tag not in FORMATTING or self.sheets or {"hidden", "style", "class", "id"} & attrs.keys():
            self.push(tag, attrs)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.place(Node("br", {}), False)
        elif tag in ("html", "body"):
            return
        elif tag in HEADINGS:
            self.close(HEADINGS, ("table", "td", "th"))
        elif tag == "p" and not self.places.get("p"):
            self.place(Node("p", {}), False)
        elif tag in ("table", "tr", *CELLS, *SECTIONS):
            self.close((tag,), () if tag == "table" else ("table",))
        elif tag in OVERLAPPING or tag in SPECIAL:
            self.close((tag,), ("td", "th", "table"))
        else:
            self.close((tag,), SPECIAL)


def _letter(c: str) -> bool:
    return c.isascii() and c.isalpha()


def _without_comments(css: str) -> str:
    out, at = [], 0
    while (begin := css.find("/*", at)) >= 0:
        out.append(css[at:begin])
        end = css.find("*/", begin + 2)
        if end < 0:
            return "".join(out)
        at = end + 2
    return "".join(out) + css[at:]


def _on_screen(head: str) -> bool:
    """Whether an at-rule's inner rules hold on any screen."""
    name, _, rest = " ".join(head.lower().split()).partition(" ")
    if name == "@media":
        return any(x.strip().removeprefix("only ") in ("screen", "all") or x.strip() == "not print" for x in rest.split(","))
    return name == "@layer" or (name == "@supports" and "not" not in re.findall(r"\w+", rest))


class Sheet:
    """Which tags, classes and ids plain rules of style sheets hide."""

    def __init__(self, sheets: list[str]):
        self.none: set[str] = set()
        self.invisible: set[str] = set()
        for sheet in sheets:
            outer: list[bool] = []  # of the open braces, whether rules in them hold
            head = ""
            parts = _BRACE.split(_without_comments(sheet))
            for before, brace in zip(parts[::2], parts[1::2], strict=False):
                if brace == "{":
                    head = before.rsplit(";", 1)[-1].strip()
                    outer.append((not outer or outer[-1]) and (not head.startswith("@") or _on_screen(head)))
                    continue
                if outer:
                    if outer[-1] and head and not head.startswith("@"):
                        self.rule(head, before)
                    outer.pop()
                head = ""

    def rule(self, head: str, body: str) -> None:
        body = re.sub(r"\s", "", body.lower())
        kind = self.none if "display:none" in body else self.invisible if "visibility:hidden" in body or "visibility:collapse" in body else None
        if kind is not None:
            kind |= {s.strip() for s in head.split(",") if re.fullmatch(r"[.#]?[\w-]+", s.strip())}

    def within(self, kind: set[str], node: Node) -> bool:
        return bool(kind) and (node.tag in kind or f"#{node.attrs.get('id')}" in kind or any(f".{c}" in kind for c in node.attrs.get("class", "").split()))


def width(text: str) -> int:
    """Columns that a line takes: wide characters two, combining marks none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Flow:
    """A block: a running paragraph, and the lines that it writes to ``out``, which it
    shares with the blocks around it. ``first`` and ``rest`` stand before its first line
    and the others; with ``lead`` a blank line comes before the first, and with ``due``
    before the next one."""

    __slots__ = ("due", "first", "lead", "margin", "out", "pre", "rest", "run", "wrote")

    def __init__(self, out: list[str], pre: bool = False, lead: bool = False, first: str = "", rest: str = "", margin: bool = False):
        self.out, self.pre, self.lead, self.first, self.rest, self.margin = out, pre, lead, first, rest, margin
        self.run: list[str] = []
        self.wrote = self.due = False

    def inner(self, margin: bool, pre: bool, first: str = "", rest: str = "") -> Flow:
        """A block in this one. What is around it writes nothing until it is closed."""
        self.flush()
        if len(self.rest) >= INDENT:
            rest = ""
        lead = margin or self.due if self.wrote else self.lead
        return Flow(self.out, pre, lead, (self.rest if self.wrote else self.first) + first, self.rest + rest, margin)

    def closed(self, child: Flow) -> None:
        child.flush()
        if child.wrote:
            self.wrote, self.due = True, child.margin

    def flush(self) -> None:
        if not self.run:
            return
        text = "".join(self.run)
        self.run = []
        if self.pre:
            self.write(text.removeprefix("\n").removesuffix("\n").split("\n"))
            return
        lines = [_SPACE.sub(" ", x).strip(" ") for x in text.split("\x00")]
        while lines and not lines[-1]:
            lines.pop()
        self.write(lines)

    def write(self, lines: list[str]) -> None:
        if not lines:
            return
        if self.due if self.wrote else self.lead:
            self.out.append("")
        begin = 0
        if not self.wrote:
            self.out.append(self.first + lines[0])
            begin = 1
        rest = self.rest
        self.out += [rest + x if x else "" for x in lines[begin:]] if rest else lines[begin:]
        self.wrote, self.due = True, False


class Frame:
    """An element that is being rendered: its children that are still to come, where they
    go, and what is to be done when they are through."""

    __slots__ = ("cells", "children", "depth", "flow", "kind", "node", "number", "outer", "shown")

    def __init__(self, node: Node, children: Iterable, flow: Flow, shown: bool, kind: str, outer: Flow | None, depth: int):
        self.node, self.children, self.flow, self.shown, self.kind, self.outer, self.depth = node, iter(children), flow, shown, kind, outer, depth
        self.number, self.cells = 1, None


class Renderer:
    """Walks the tree with a stack of its own, so that no depth is too deep."""

    def __init__(self, sheet: Sheet):
        self.sheet = sheet
        self.stack: list[Frame] = []

    def unseen(self, node: Node) -> bool:
        if node.tag in UNSEEN or (node.tag == "dialog" and "open" not in node.attrs):
            return True
        if not node.attrs:
            return self.sheet.within(self.sheet.none, node)
        style = node.attrs.get("style")
        return "hidden" in node.attrs or (style is not None and "display:none" in _SPACE.sub("", style.lower())) or self.sheet.within(self.sheet.none, node)

    def shown(self, node: Node, shown: bool) -> bool:
        style = _SPACE.sub("", node.attrs.get("style", "").lower()) if node.attrs else ""
        if "visibility:visible" in style:
            return True
        if "visibility:hidden" in style or "visibility:collapse" in style or self.sheet.within(self.sheet.invisible, node):
            return False
        return shown

    def render(self, root: Node) -> list[str]:
        out: list[str] = []
        whole = Flow(out)
        self.enter(root, whole, self.shown(root, True), "in", None, 0)
        while self.stack:
            frame = self.stack[-1]
            for child in frame.children:
                if frame.kind == "table":
                    self.cell(frame, child)
                elif isinstance(child, str):
                    self.string(frame, child)
                elif not self.unseen(child):
                    self.child(frame, child)
                if self.stack[-1] is not frame:
                    break
            else:
                self.leave(self.stack.pop())
        whole.flush()
        return out

    def enter(self, node: Node, flow: Flow, shown: bool, kind: str, outer: Flow | None, depth: int) -> None:
        """``outer`` is the block that ``flow`` is closed into, None if it is its own."""
        children = node.children
        if node.tag == "details" and "open" not in node.attrs:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        self.stack.append(Frame(node, children, flow, shown, kind, outer, depth))

    def leave(self, frame: Frame) -> None:
        if frame.kind == "table":
            frame.flow.write(_aligned(*frame.cells))
        elif frame.kind in ("label", "stacked"):
            frame.flow.run.append(" ")
        if frame.outer is not None:
            frame.outer.closed(frame.flow)

    def string(self, frame: Frame, text: str) -> None:
        if not frame.shown or frame.kind == "drawing":
            return
        flow = frame.flow
        if frame.kind == "list":
            if not text.strip(" \t\n\r\f"):
                return
            flow = flow.inner(False, False)
        elif frame.kind == "stacked":
            flow.run.append(" ")
        flow.run.append(text if flow.pre else text.replace("\x00", ""))
        if flow is not frame.flow:
            frame.flow.closed(flow)

    def child(self, frame: Frame, node: Node) -> None:
        flow, tag, shown, parent = frame.flow, node.tag, self.shown(node, frame.shown), frame.node.tag
        if frame.kind == "drawing":
            if tag not in SVG_UNSEEN and node.attrs.get("display") != "none":
                label = tag in ("text", "foreignobject")
                if label:
                    flow.run.append(" ")
                self.enter(node, flow, shown, "label" if label else "drawing", None, frame.depth)
            return
        if frame.kind == "list":
            if tag == "li":
                value = node.attrs.get("value", "")
                if _LIKE_NUMBER.fullmatch(value):
                    frame.number = int(value)
                mark = f"{frame.number}. " if parent == "ol" else "- "
                frame.number += 1
                self.enter(node, flow.inner(False, False, mark, " " * len(mark)), shown, "in", flow, frame.depth)
                return
            # What is no item stands in a block of its own.
            holder = Node("div", {})
            holder.children.append(node)
            self.enter(holder, flow.inner(False, False), frame.shown, "in", flow, frame.depth)
            return
        if frame.kind == "stacked":
            flow.run.append(" ")
        if tag == "br":
            flow.run.append("\n" if flow.pre else "\x00")
        elif tag == "hr":
            flow.flush()
            flow.due = True
        elif tag == "input":
            if shown and node.attrs.get("type", "").lower() in ("submit", "button", "reset"):
                flow.run.append(node.attrs.get("value", ""))
        elif tag == "svg":
            self.enter(node, flow, shown, "drawing", None, frame.depth)
        elif tag in STACKED:
            self.enter(node, flow, shown, "stacked", None, frame.depth)
        elif tag == "table" and frame.depth < TABLES:
            self.table(node, flow.inner(True, False), shown, flow, frame.depth + 1)
        elif tag in ("ul", "ol", "menu", "dir"):
            self.enter(node, flow.inner(parent != "li", False), shown, "list", flow, frame.depth)
            start = node.attrs.get("start", "")
            self.stack[-1].number = int(start) if _LIKE_NUMBER.fullmatch(start) else 1
        elif tag in BLOCK or tag in CELLS:
            indent = "  " if tag in ("blockquote", "dd") else ""
            self.enter(node, flow.inner(tag in MARGIN, flow.pre or tag in ("pre", "textarea", "xmp"), indent, indent), shown, "in", flow, frame.depth)
        else:
            self.enter(node, flow, shown, "in", None, frame.depth)

    def table(self, node: Node, flow: Flow, shown: bool, outer: Flow, depth: int) -> None:
        """A frame whose children are the captions and cells, as (row, node, shown)."""
        parts: list[tuple[int, Node, bool]] = [(-1, c, self.shown(c, shown)) for c in node.children if isinstance(c, Node) and c.tag == "caption" and not self.unseen(c)]
        rows: list[int] = []  # for each row, the first row behind its section
        for part in node.children:
            if isinstance(part, Node) and part.tag in SECTIONS and not self.unseen(part):
                seen, first = self.shown(part, shown), len(rows)
                for row in part.children:
                    if isinstance(row, Node) and row.tag == "tr" and not self.unseen(row):
                        visible = self.shown(row, seen)
                        parts += [(len(rows), c, self.shown(c, visible)) for c in row.children if isinstance(c, Node) and c.tag in CELLS and not self.unseen(c)]
                        rows.append(0)
                rows[first:] = [len(rows)] * (len(rows) - first)
        self.stack.append(frame := Frame(node, parts, flow, shown, "table", outer, depth))
        frame.cells = ([], [], rows)

    def cell(self, frame: Frame, part: tuple[int, Node, bool]) -> None:
        row, node, shown = part
        lines: list[str] = []
        above, cells, _ = frame.cells
        if row < 0:
            above.append(lines)
        else:
            cells.append((row, _span(node, "colspan", COLSPAN), _span(node, "rowspan", ROWSPAN), lines))
        holder = Flow(lines)
        self.enter(node, holder, shown, "in", holder, frame.depth)


def _span(cell: Node, name: str, most: int) -> int:
    value = cell.attrs.get(name, "")
    if not (value.isdecimal() and value.isascii()):
        return 1
    if name == "rowspan" and not value.strip("0"):
        return most  # to the end of the section
    return max(1, min(most, int(value[-9:]) if not value[:-9].strip("0") else most))


def _aligned(above: list[list[str]], cells: list[tuple[int, int, int, list[str]]], rows: list[int]) -> list[str]:
    """Lines of a table: captions, then rows of (row, columns, rows, lines) whose cells
    begin in the same place as others of their column."""
    placed: list[tuple[int, int, int, list[str]]] = []  # row, column, column behind, lines
    taken: list[tuple[int, int, int]] = []  # columns that cells of earlier rows fill, and up to which row
    new: list[tuple[int, int, int]] = []
    at, k, last = 0, 0, -1
    for row, across, down, lines in cells:
        if row != last:
            taken = _merged([x for x in heapq.merge(taken, new) if x[2] > row])
            new, at, k, last = [], 0, 0, row
        while k < len(taken) and taken[k][0] <= at:
            at = max(at, taken[k][1])
            k += 1
        placed.append((row, at, at + across, lines))
        if down > 1 and row + 1 < rows[row]:
            new.append((at, at + across, min(row + down, rows[row])))
        at += across
    # Columns in which no cell begins take no place.
    starts = sorted({x[1] for x in placed})
    ending: list[list[tuple[int, int]]] = [[] for _ in starts]
    for _, begin, end, lines in placed:
        if (k := bisect.bisect_left(starts, end)) < len(starts):
            ending[k].append((bisect.bisect_left(starts, begin), max(map(width, lines), default=0)))
    place = [0] * len(starts)
    for k in range(1, len(starts)):
        place[k] = max([place[k - 1] + 2, *[place[i] + w + 2 for i, w in ending[k]]])
    column = dict(zip(starts, place, strict=True))
    out = [x for lines in above for x in lines]
    for _, row in itertools.groupby(placed, lambda x: x[0]):
        row = [x for x in row if x[3]]
        for k in range(max((len(x[3]) for x in row), default=0)):
            line, used = [], 0
            for x in row:
                if k < len(x[3]) and x[3][k]:
                    gap = max(min(column[x[1]], ALIGNED) - used, 2 if line else 0)
                    line.append(" " * gap + x[3][k])
                    used += gap + width(x[3][k])
            out.append("".join(line).rstrip())
    while out and not out[-1]:
        out.pop()
    return out


def _merged(taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Sorted columns, where neighbours that are taken up to the same row are one."""
    out: list[tuple[int, int, int]] = []
    for x in taken:
        if out and out[-1][1] == x[0] and out[-1][2] == x[2]:
            out[-1] = (out[-1][0], x[1], x[2])
        else:
            out.append(x)
    return out


def render(page: str | None) -> str:
    """The visible text of a page; None and empty pages have an empty text."""
    if not page:
        return ""
    built = Builder(page)
    renderer = Renderer(Sheet(built.sheets))
    return "" if renderer.unseen(built.root) else "\n".join(renderer.render(built.root))


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the visible text in ``text_col`` (in place of a column of that
    name) instead of the html. Null html gives an empty text; repeated rows each get
    their own; the whole page is rendered, however long. No row leaves its partition."""
    bound_batches(pages.sparkSession, 500)
    rest = [c for c in pages.columns if c not in (html_col, text_col)]
    rows = pages.select(*rest, F.col(html_col).cast("string").alias(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 500):
            texts = [render(b.decode("utf-8", "replace") if b else None) for b in as_bytes(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def op8_html(spark, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "html"))
    return found.select("page_id", "text", F.length("text").cast("bigint").alias("n_chars"), F.when(F.length("text") > 0, F.size(F.split("text", "\n"))).otherwise(0).cast("bigint").alias("n_lines"))
