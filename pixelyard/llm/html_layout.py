"""Visible text of HTML pages, laid out: a tree builder with implied tags, visibility rules, and a renderer."""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template title noscript iframe noembed noframes object canvas audio video datalist area base link meta param source track col colgroup desc defs metadata symbol annotation annotation-xml".split())
#: inputs whose value is on the page
VALUED = frozenset("text search url tel email number date time button submit reset".split())
#: longer cells don't widen their column, or one would pad every row of its table
WIDEST = 120
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary ul table caption".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu hr".split())
#: start tags that close an open p
ENDS_P = BLOCKS - {"body", "html", "caption"}
#: start tag: open tags that it closes, and where the search for one stops
IMPLIED: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})),
    "tr": (frozenset({"tr", "td", "th", "caption"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "thead": (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}), frozenset({"table"})),
    "tbody": (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}), frozenset({"table"})),
    "tfoot": (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}), frozenset({"table"})),
    "body": (frozenset({"head"}), frozenset({"html"})),
}
#: an end tag closes nothing beyond these
WALLS = frozenset({"table", "td", "th", "caption", "template"})
#: a start tag closes no p beyond these
P_WALLS = WALLS | {"button", "li", "div"}
FREE_ENDS = frozenset({"table", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "template", "body", "html"})

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HIDES = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")


@dataclass
class Element:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)  # elements and texts


def build(page: str) -> Element:
    """The page's tree; any input has one."""
    root = Element("html")
    stack = [root]
    places: dict[str, list[int]] = {}  # of the open elements of a tag, so that no tag is sought through the stack

    def push(element: Element) -> None:
        stack[-1].children.append(element)
        places.setdefault(element.tag, []).append(len(stack))
        stack.append(element)

    def close(number: int) -> None:
        while len(stack) > number:
            places[stack.pop().tag].pop()

    def last(tags: Iterable[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    at = 0
    while at < len(page):
        found = MARKUP.search(page, at)
        if found is None:
            stack[-1].children.append(html.unescape(page[at:]))
            break
        if found.start() > at:
            stack[-1].children.append(html.unescape(page[at : found.start()]))
        at = found.end()
        if found[1] is not None:
            stack[-1].children.append(found[1])
        tag = (found[3] or "").lower()
        if not tag:
            continue
        if found[2]:
            i, wall = last((tag,)), 0 if tag in FREE_ENDS else last(WALLS)
            if i > wall:
                close(i)
            elif not wall and tag in ("p", "br"):
                stack[-1].children.append(Element(tag))
            continue
        if tag == "html" and len(stack) == 1 and not any(isinstance(c, Element) for c in root.children):
            root.attributes = attributes(found[4])
            continue
        if tag in ENDS_P:
            i = last(("p",))
            if i > last(P_WALLS):
                close(i)
        if tag not in ("html", "head", "body") and tag in BLOCKS and stack[-1].tag == "head":
            close(len(stack) - 1)
        if tag in IMPLIED:
            closes, stops = IMPLIED[tag]
            stop = last(stops)
            above = [held[i] for t in closes if (held := places.get(t)) and (i := bisect.bisect_right(held, stop)) < len(held)]
            if above:
                close(min(above))
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            push(Element("tr"))
        element = Element(tag, attributes(found[4]))
        if tag in VOID:
            stack[-1].children.append(element)
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I).search(page, at)
            element.children.append(html.unescape(page[at : end.start()]) if tag == "textarea" else page[at : end.start()])
            stack[-1].children.append(element)
            at = end.end()
            continue
        push(element)
    return root


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)} if text and not text.isspace() else {}


def unseen(element: Element) -> bool:
    a = element.attributes
    return element.tag in UNSEEN or element.tag == "dialog" and "open" not in a or bool(a) and ("hidden" in a or bool(HIDES.search(a.get("style", ""))))


def shown(select: Element) -> list[Element]:
    """The options that a select shows: all of a list, of a closed one the chosen or first one."""
    options, work = [], list(select.children)
    while work:
        x = work.pop(0)
        if isinstance(x, Element):
            if x.tag == "option":
                options.append(x)
            else:
                work = x.children + work
    if "multiple" in select.attributes or not options:
        return options
    return [next((o for o in options if "selected" in o.attributes), options[0])]


class Writer:
    """Lines of one flow of text: the page's, or a table cell's."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap = 0  # line ends due before the next text
        self.space = False
        self.indent: list[list[str]] = []  # of each level, what the next line and what later ones start with

    def prefix(self) -> str:
        lead = "".join(level[0] for level in self.indent)
        for level in self.indent:
            level[0] = level[1]
        return lead

    def open_line(self) -> None:
        if self.gap and self.lines:
            self.lines += [""] * (self.gap - 1)
        self.gap = 0
        self.parts.append(self.prefix())

    def text(self, words: str) -> None:
        flat = SPACE.sub(" ", words)
        if flat == " " or not flat:
            self.space |= bool(flat)
            return
        if not self.parts:
            self.open_line()
        elif self.space or flat[0] == " ":
            self.parts.append(" ")
        self.parts.append(flat.strip(" "))
        self.space = flat[-1] == " "

    def verbatim(self, text: str) -> None:
        for i, line in enumerate(text.split("\n")):
            if i:
                self.end(1)
                self.gap = 0
            if not self.parts:
                self.open_line()
            self.parts.append(line.rstrip("\r"))

    def end(self, gap: int) -> None:
        if self.parts:
            self.lines.append("".join(self.parts).rstrip())
            self.parts = []
        self.space = False
        self.gap = max(self.gap, gap)

    def line_break(self) -> None:
        if self.parts:
            self.end(1)
        elif self.lines:
            self.gap = min(2, max(self.gap, 1) + 1)

    def done(self) -> str:
        self.end(0)
        return "\n".join(self.lines).strip("\n")


def aligned(rows: list[list[tuple[str, int]]]) -> list[str]:
    """Rows of (cell text, columns it spans) as lines with cells one below the other."""
    rows = [r for r in rows if r]
    width: list[int] = []
    for row in rows:
        column = 0
        for text, span in row:
            while len(width) < column + span:
                width.append(0)
            if span == 1:
                width[column] = max([width[column], *(n for n in map(len, text.split("\n")) if n <= WIDEST)])
            column += span
    for row in rows:  # a spanning cell widens its last column
        column = 0
        for text, span in row:
            if span > 1:
                lack = max((n for n in map(len, text.split("\n")) if n <= WIDEST), default=0) - sum(width[column : column + span]) - 3 * (span - 1)
                width[column + span - 1] += max(0, lack)
            column += span
    out = []
    for row in rows:
        cells, column = [], 0
        for text, span in row:
            cells.append((text.split("\n"), sum(width[column : column + span]) + 3 * (span - 1)))
            column += span
        for i in range(max(len(lines) for lines, _ in cells)):
            out.append(" | ".join((lines[i] if i < len(lines) else "").ljust(w) for lines, w in cells).rstrip())
    return out


def render(root: Element) -> str:
    """The visible text.  Works with a stack of its own, so depth is no matter."""
    writers = [Writer()]
    tables: list[list[list[tuple[str, int]]]] = []
    lists: list[list] = []  # kind and next number
    preformatted = 0
    hidden = [False]  # of the element and those around it: visibility is inherited, and may be taken back
    work: list[tuple[bool, Element | str]] = [(True, root)]
    while work:
        enter, node = work.pop()
        out = writers[-1]
        if isinstance(node, str):
            if hidden[-1]:
                continue
            out.verbatim(node) if preformatted else out.text(node)
            continue
        tag = node.tag
        if enter:
            if unseen(node):
                continue
            visibility = VISIBILITY.search(node.attributes.get("style", "")) if node.attributes else None
            hides = hidden[-1] if visibility is None else visibility[1].lower() != "visible"
            if tag == "input":
                if not hides and node.attributes.get("type", "text").lower() in VALUED:
                    out.text(f" {node.attributes.get('value', '')} ")
                continue
            if tag == "br":
                out.line_break()
                continue
            if tag in BLOCKS:
                out.end(2 if tag in SPACED and not (lists and tag in ("ul", "ol", "menu")) else 1)
            if tag in ("ul", "ol", "menu"):
                start = node.attributes.get("start", "1")
                lists.append([tag, int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1])
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 1]
                marker = f"{kind[1]}. " if kind[0] == "ol" else "- "
                kind[1] += 1
                out.indent.append([marker, " " * len(marker)])
            elif tag in ("blockquote", "dd"):
                out.indent.append(["    " if tag == "dd" else "> "] * 2)
            elif tag == "pre":
                preformatted += 1
            elif tag == "hr":
                if not hides:
                    out.text("---")
                out.end(2)
                continue
            elif tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables and tables[-1]:
                writers.append(Writer())
                lists.append(["ul", 1])
            hidden.append(hides)
            work.append((False, node))
            children = shown(node) if tag == "select" else node.children
            if tag in ("option", "select", "textarea", "text"):
                out.space = True
            for i, child in enumerate(reversed(children)):
                if tag == "pre" and isinstance(child, str) and i == len(children) - 1 and child[:1] == "\n":
                    child = child[1:]
                work.append((True, child))
            continue
        hidden.pop()
        if tag in ("option", "select", "textarea", "text"):
            out.space = True
        if tag in ("ul", "ol", "menu"):
            lists.pop()
        elif tag in ("li", "blockquote", "dd"):
            out.end(1)
            out.indent.pop()
        elif tag == "pre":
            preformatted -= 1
        elif tag in ("td", "th") and tables and tables[-1] and len(writers) > 1:
            cell = writers.pop().done()
            lists.pop()
            span = node.attributes.get("colspan", "1")
            tables[-1][-1].append((cell, min(100, max(1, int(span))) if re.fullmatch("[0-9]{1,4}", span) else 1))
        elif tag == "table":
            for line in aligned(tables.pop()):
                out.end(1)
                out.gap = min(out.gap, 2)
                out.verbatim(line)
                out.end(1)
        if tag in BLOCKS:
            out.end(2 if tag in SPACED and not (lists and tag in ("ul", "ol", "menu")) else 1)
    return writers[0].done()


def page_text(page: str | None) -> str:
    return render(build(page)) if page else ""


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per input row: id, text.

    text is all that a reader sees: paragraphs parted by a blank line, other blocks by a line end, list
    items with markers, cells of a table row side by side and aligned (one of more than WIDEST characters
    widens no column), preformatted text as it is.  Values of form fields, the chosen option of a select, text
    in svg and math, open dialogs, details and what is hidden from screen readers alone are seen.  Elements with
    display: none or hidden, those with visibility: hidden but for the parts that take it back, scripts, styles,
    media, the head and comments are left out.  Markup that is broken or
    cut off still gives a tree; null and empty pages give an empty text.  Other columns are left out.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [page_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    source = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).cast("string").alias("html"))
    return source.mapInArrow(extract, "id long, text string").withColumnRenamed("id", id_col)
