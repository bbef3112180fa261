"""Op 4: text of web pages as laid out: a tree builder with implied tags, visibility rules, and a block renderer.

The tree builder closes what HTML lets authors leave open (p, li, dt, dd, option, tr, td, th, table sections), opens
what they leave out (tbody, tr), ignores end tags that match nothing, and reads script, style and the like as raw
text. Elements that browsers don't show (head, script, style, template, `hidden`, display:none, closed dialogs, hidden
inputs, the unchosen options of a closed select, definitions and descriptions in drawings) are left out, and text of
visibility:hidden but for what is made visible again within it; all other text is emitted, formulas and text in
drawings too, whatever its place in the page.

Blocks stand on lines of their own, paragraphs and headings apart by a blank line; list items carry a bullet or
number and nest by two spaces; table cells of a column are padded to one width and set apart by " | ", cells that span
columns or rows keep the others in their columns; pre keeps its white space. White space elsewhere collapses. Layout is
kept at any depth; only the indentation stops growing after INDENT spaces.

Null and empty pages give the empty text; unclosed or deeply nested markup is read to its end without recursion, in
time that grows as the page. A tag that no ">" ends before the next tag is text. Rows that repeat a page_id are each
rendered, and null ids too; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Element names by what HTML says of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
UNSEEN = frozenset("head script style template noscript iframe object embed audio video canvas datalist title meta link base noembed noframes param rp area desc defs metadata symbol clippath mask marker pattern annotation annotation-xml".split())
BLOCK = frozenset("html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table tbody td text tfoot th thead tr ul caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu table pre blockquote figure fieldset".split())
CLOSES_P = BLOCK - frozenset("html body td th tr tbody thead tfoot caption option optgroup legend text p".split()) | {"p"}
#: Start tag: open elements that it ends, and the elements beyond which it doesn't look.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"td", "th", "tr", "caption", "colgroup"}, {"table", "tbody", "thead", "tfoot"}),
    **{t: ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}) for t in ("tbody", "thead", "tfoot")},
    "body": ({"head"}, set()),
}
#: Open elements beyond which a start tag closes no paragraph, and beyond which an end tag closes none but a table's parts.
P_BOUND = ("table", "td", "th", "caption", "button", "object")
CELL_BOUND = ("table", "td", "th")
TABLE_PARTS = frozenset("table tr td th tbody thead tfoot body html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An attribute as the tokenizer of HTML reads it: a quote opens a value after "=" only and is any other character
#: elsewhere. "<" before a letter, "/" or "!" starts the next tag, so that no tag is sought beyond it.
_OPENS = r"<(?=[a-zA-Z/!])"
_PAIR = rf"((?:(?!{_OPENS})[^\s/>])(?:(?!{_OPENS})[^\s/>=])*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|((?!{_OPENS})[^\s>\"'](?:(?!{_OPENS})[^\s>])*+)))?+"
_ATTR = re.compile(_PAIR)
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z](?:(?!{_OPENS})[^\s/>])*+)((?:[\s/]++|(?:{_PAIR.replace('([', '(?:[').replace('((', '(?:(')}))*+)>|<[!?/][^>]*(?:>|\Z)", re.S)
_HIDES = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_VISIBLE = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)\b", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")
#: Spaces of indentation at most; columns in which cells that span rows leave room below.
INDENT, SPANNED = 120, 500


class Node:
    __slots__ = ("children", "name", "hidden", "attrs", "shown")

    def __init__(self, name: str, shown: bool = True, attrs: dict[str, str] | None = None):
        self.name, self.shown, self.attrs, self.children = name, shown, attrs or {}, []
        self.hidden = bool(name in UNSEEN or attrs and is_hidden(name, attrs)) or name == "dialog" and "open" not in self.attrs

    def number(self, name: str) -> int | None:
        value = self.attrs.get(name, "").strip()
        return int(value) if re.fullmatch(r"-?[0-9]{1,9}", value) else None


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): unescape(next((v for v in m.groups()[1:] if v is not None), "")) for m in _ATTR.finditer(source)}


def is_hidden(name: str, attrs: dict[str, str]) -> bool:
    return "hidden" in attrs or bool(_HIDES.search(attrs.get("style", "")))


class Stack:
    """Open elements, with the places of each name, so that the nearest of some names is found without a walk."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    def top(self) -> Node:
        return self.nodes[-1]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.nodes))
        self.nodes.append(node)

    def add(self, child: Node | str) -> None:
        self.nodes[-1].children.append(child)

    def open(self, name: str) -> None:
        node = Node(name, self.top().shown)
        self.add(node)
        self.push(node)

    def nearest(self, names) -> int:
        """Place of the innermost open element with one of the names; 0 if there is none."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def cut(self, place: int) -> None:
        """Closes the element at that place and all within it."""
        while len(self.nodes) > place:
            self.places[self.nodes.pop().name].pop()


def tree(html: str) -> Node:
    """Elements and strings under one root; every open element is on a stack, without recursion."""
    root = Node("html")
    stack, at = Stack(root), 0

    def text(s: str) -> None:
        if s:
            stack.add(unescape(s) if stack.top().shown else " ")

    while at < len(html):
        m = _TOKEN.search(html, at)
        text(html[at : m.start() if m else len(html)])
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            close(stack, name)
            continue
        attrs = attributes(m[3]) if m[3].strip(" /\n\t") else {}
        imply(stack, name)
        if name == "html":
            continue
        shown = _VISIBLE.search(attrs.get("style", ""))
        node = Node(name, shown[1].lower() == "visible" if shown else stack.top().shown, attrs)
        stack.add(node)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
            raw = html[at : end.start() if end else len(html)]
            if node.shown:
                node.children.append(unescape(raw) if name in ("title", "textarea") else raw)
            at = end.end() if end else len(html)
        elif name not in VOID:
            stack.push(node)
    return root


def close(stack: Stack, name: str) -> None:
    """An end tag: closes the nearest element of that name; inside a cell, none beyond its table."""
    place = stack.nearest((name,))
    if place and (name in TABLE_PARTS or place > stack.nearest(CELL_BOUND)):
        stack.cut(place)
    elif name in ("p", "br"):
        stack.add(Node(name, stack.top().shown))


def imply(stack: Stack, name: str) -> None:
    """Ends and beginnings that a start tag implies."""
    if name in CLOSES_P:
        place = stack.nearest(("p",))
        if place > stack.nearest(P_BOUND):
            stack.cut(place)
    if name in HEADINGS and stack.top().name in HEADINGS:
        stack.cut(len(stack.nodes) - 1)
    if name in BLOCK and stack.top().name == "head":
        stack.cut(len(stack.nodes) - 1)
    if name in ENDS:
        ends, bound = ENDS[name]
        # once for a cell, again for its row or section; a section within a table ends them all
        while (place := stack.nearest(ends)) > stack.nearest(bound):
            stack.cut(place)
            if name not in ("tr", "tbody", "thead", "tfoot"):
                break
    if name in ("tr", "td", "th") and stack.top().name == "table":
        stack.open("tbody")
    if name in ("td", "th") and stack.top().name in ("tbody", "thead", "tfoot"):
        stack.open("tr")


class Lines:
    """Lines of a box: strings, and boxes within it with their mark and indentation, which are applied at the end."""

    __slots__ = ("parts",)

    def __init__(self, parts: list | None = None):
        self.parts = parts or []

    def put(self, lines: "Lines", mark: str = "", indent: int = 0) -> None:
        if lines.parts:
            self.parts.append((mark, indent, lines))

    def flat(self) -> list[str]:
        out, marks, since, todo = [], [], 0, [(iter(self.parts), 0, 0)]
        while todo:
            parts, indent, rest = todo[-1]
            x = next(parts, None)
            if x is None:
                todo.pop()
            elif isinstance(x, str):
                if marks:
                    out.append("".join(marks) + x)
                    marks = []
                    todo[since:] = [(p, r, r) for p, _, r in todo[since:]]  # the boxes that the marks opened go on with spaces
                else:
                    out.append(" " * min(indent, INDENT) + x if x else "")
            else:
                mark, more, lines = x
                if mark or more:
                    if not marks:
                        marks, since = [" " * min(indent, INDENT)], len(todo)
                    marks.append(mark or " " * more)
                todo.append((iter(lines.parts), indent if not (mark or more) else rest + len(mark) + more, rest + len(mark) + more))
        return out


class Page:
    """Lines of a layout box; gap: lines to leave before the next text."""

    def __init__(self):
        self.lines, self.words, self.gap = Lines(), [], 0

    def flush(self) -> None:
        line = _SPACE.sub(" ", "".join(self.words)).strip(" ")
        self.words = []
        if line:
            self.put(Lines([line]))

    def put(self, lines: Lines, indent: int = 0) -> None:
        if self.gap and self.lines.parts:
            self.lines.parts += [""] * self.gap
        self.gap = 0
        if indent:
            self.lines.put(lines, "", indent)
        else:
            self.lines.parts += lines.parts

    def space(self, n: int) -> None:
        self.flush()
        self.gap = max(self.gap, n)


LISTS = frozenset(("ul", "ol", "menu"))
BOXES = LISTS | {"table", "blockquote", "dd", "pre"}


def rendered(box) -> Lines:
    """Runs a box, which yields the boxes within it and is sent their lines; without recursion."""
    todo, got = [box], None
    while todo:
        try:
            todo.append(todo[-1].send(got))
            got = None
        except StopIteration as e:
            todo.pop()
            got = e.value
    return got


def layout(children: list, within: bool = False):
    """Lines of a box. Walks the box's own elements with a stack."""
    page, todo = Page(), [("in", c) for c in reversed(children)]
    while todo:
        step, x = todo.pop()
        if isinstance(x, str):
            page.words.append(x)
        elif step == "out":
            page.space(1 if x.name in SPACED else 0)
        elif x.name == "br":
            page.flush()
        elif x.name == "hr":
            page.space(0)
        elif not x.hidden:
            if x.name in BOXES:
                gap = 1 if x.name in SPACED and not (within and x.name in LISTS) else 0
                page.space(gap)
                lines = kept(x) if x.name == "pre" else (yield items(x) if x.name in LISTS else table(x) if x.name == "table" else layout(x.children, True))
                if lines.parts:
                    page.put(lines, 2 if x.name in ("blockquote", "dd") else 0)
                page.space(gap)
                continue
            if x.name in BLOCK:
                page.space(1 if x.name in SPACED else 0)
                todo.append(("out", x))
            todo += [("in", c) for c in reversed(chosen(x) if x.name == "select" else x.children)]
    page.flush()
    return page.lines


def chosen(node: Node) -> list:
    """Of a closed select the chosen option's content, of an open one everything."""
    if "multiple" in node.attrs or (node.number("size") or 0) > 1:
        return node.children
    options, todo = [], list(reversed(node.children))
    while todo:
        x = todo.pop()
        if isinstance(x, Node) and not x.hidden:
            if x.name == "option":
                options.append(x)
            else:
                todo += reversed(x.children)
    picked = [x for x in options if "selected" in x.attrs][-1:] or options[:1]
    return [" ", *(c for x in picked for c in x.children), " "]


def items(node: Node):
    lines, n = Lines(), (node.number("start") if node.name == "ol" else None)
    n = 1 if n is None else n
    for child in node.children:
        if isinstance(child, str) or child.name != "li":
            if not isinstance(child, str) or child.strip(" \t\n\r\f"):
                lines.put((yield layout([child], True)), "", 2)
        elif not child.hidden:
            mark = f"{n}. " if node.name == "ol" else "- "
            n += 1
            lines.put((yield layout(child.children, True)), mark)
    return lines


def table(node: Node):
    """Caption and loose text, then rows with cells of a column padded to one width; a cell's blocks share its line.

    A cell that spans columns is as wide as they are; one that spans rows leaves its columns empty in those below.
    """
    lines, rows, todo, below = Lines(), [], list(reversed(node.children)), {}
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if x.strip(" \t\n\r\f"):
                lines.parts.append(_SPACE.sub(" ", x).strip(" "))
        elif x.hidden:
            continue
        elif x.name in ("tbody", "thead", "tfoot"):
            todo += reversed(x.children)
            below = {}
        elif x.name == "tr":
            row, column, taken = [], 0, {c: n - 1 for c, n in below.items() if n > 1}
            for c in x.children:
                cell = isinstance(c, Node) and c.name in ("td", "th")
                if isinstance(c, Node) and c.hidden and not cell:
                    continue
                inner = [] if isinstance(c, Node) and c.hidden else (yield layout(c.children if cell else [c], True)).flat()
                text = " ".join(y.strip() for y in inner if y)
                if not cell and not text:
                    continue
                while column in below:
                    column += 1
                across = min(max((c.number("colspan") if cell else None) or 1, 1), 1000)
                down = min(max((c.number("rowspan") if cell else None) or 1, 1), 65534)
                row.append((column, across, text))
                if down > 1:
                    taken |= dict.fromkeys(range(column, min(column + across, SPANNED)), down - 1)
                column += across
            rows.append(row)
            below = taken
        else:
            lines.put((yield layout([x], True)))
    last = max((column for row in rows for column, _, _ in row), default=0)
    widths: dict[int, int] = {}
    for row in rows:
        for column, across, text in row:
            if across == 1:
                widths[column] = max(widths.get(column, 0), len(text))
    wide = lambda column, across: sum(widths.get(c, 0) for c in range(column, min(column + across, last + 1))) + 3 * (min(column + across, last + 1) - column - 1)
    for row in rows:
        for column, across, text in row[:-1]:  # what no cell follows may stand out
            if across > 1 and (more := len(text) - wide(column, across)) > 0:
                end = min(column + across, last + 1) - 1
                widths[end] = widths.get(end, 0) + more
    for row in rows:
        parts, at = [], 0
        for column, across, text in row:
            parts += [" " * widths.get(c, 0) for c in range(at, column)]
            parts.append(text.ljust(wide(column, across)))
            at = column + across
        if line := " | ".join(parts).rstrip():
            lines.parts.append(line)
    return lines


def kept(node: Node) -> Lines:
    """Lines of preformatted text as they are."""
    parts, todo = [], list(reversed(node.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x.name == "br":
            parts.append("\n")
        elif not x.hidden:
            todo += reversed(x.children)
    lines = [x.rstrip() for x in "".join(parts).strip("\r\n").split("\n")]
    return Lines(lines if any(lines) else [])


def render(html: str) -> str:
    return "\n".join(rendered(layout(tree(html.replace("\0", "\ufffd")).children)).flat())


def extracted(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text; one narrow pass."""

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {"page_id": batch.column("page_id"), "extracted": [render(h or "") for h in batch.column("text").to_pylist()]}

    own = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{html_col}`").cast("string").alias("text"))
    return C.mapped(own, step, "page_id long, extracted string").withColumnRenamed("extracted", "text")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    return extracted(C.table(spark, sf_dir, "pages")).select("page_id", F.length("text").cast("long").alias("n_chars"), lines.alias("n_lines"), F.sha2("text", 256).alias("text_sha256"), "text")
