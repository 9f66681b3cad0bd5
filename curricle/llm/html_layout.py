"""HTML to text as it is laid out: all visible text, with blocks, lists and tables.

A tree builder reads tags with implied ends (paragraphs, list items, table parts, options)
and decides what is visible: no head, scripts, styles, templates or fall-back content, no
element hidden by attribute or inline style, no closed details.  Text of formulas (MathML)
and drawings (SVG) counts, but not their titles, definitions and annotations; text between
the parts of a table stands before it, as browsers show it.  The layout keeps blank lines
between blocks, marks and indents list items, numbers ordered ones, keeps white space of
preformatted text and aligns table cells in columns.  Values of form fields are not text of
the page and are left out.

It is row local: one page at a time in Arrow batches, with explicit stacks, so deep nesting
is no recursion and time grows with the length of the page.  Null, empty and tagless pages
give their (perhaps empty) text; repeated rows are alike; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A tag with its quoted attributes, a comment or a declaration.  Possessive, so it never backtracks.
MARKUP = re.compile(
    r"<(?:!--(?P<comment>)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)"
    r"(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|[!?/][^>]*+>)"
)
LOOSE_TAG = re.compile(r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>[^>]*+)>")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
STYLE = re.compile(r"(?<![\w-])(display|visibility)\s*:\s*([a-z-]+)")
COMMENT_END = re.compile(r"--!?>")
#: References to characters by more digits than any code has; leading zeros say nothing.
ZEROS = re.compile(r"&#0+(?=\d)")
TOO_LARGE = re.compile(r"&#[1-9]\d{7,};?")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset(
    "head script style template noscript title iframe object video audio canvas datalist "
    "noembed noframes".split()
)
#: Elements of SVG and MathML that are not drawn where they stand.
FOREIGN_HIDDEN = frozenset(
    "desc defs metadata symbol clippath mask pattern marker annotation annotation-xml".split()
)
#: Elements of SVG and MathML that hold HTML, and tags of HTML that end SVG and MathML.
HOLDS_HTML = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing "
    "menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
TABLE_PARTS = frozenset("table tr tbody thead tfoot".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol "
    "optgroup option p plaintext pre search section summary table ul xmp caption".split()
)
#: Blocks with a blank line before and after.
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre ul menu table".split())
ENDS_PARAGRAPH = BLOCKS - frozenset("dd dt li option optgroup legend caption summary body html".split())
#: A start tag ends open elements of these names, up to a border.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "td": (frozenset(["td", "th"]), frozenset(["table"])),
    "th": (frozenset(["td", "th"]), frozenset(["table"])),
    "tr": (frozenset(["td", "th", "tr", "caption", "colgroup"]), frozenset(["table"])),
} | {
    part: (frozenset(["td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"]), frozenset(["table"]))
    for part in ("tbody", "thead", "tfoot")
}
BORDERS = frozenset(["table", "td", "th", "caption", "html"])
#: Columns are padded up to this width; longer cells stand out, they are not cut.
WIDEST_COLUMN = 60


class Flow:
    """Lines of one block context: the page, or a table cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = 0
        self.indents: list[str] = []
        self.marker = ""

    def text(self, value: str) -> None:
        words = value.split()
        if not words:
            self.space = self.space or bool(value)
            return
        joined = " ".join(words)
        if (self.space or value[0].isspace()) and self.line:
            joined = " " + joined
        self.line.append(joined)
        self.space = value[-1].isspace()

    def verbatim(self, value: str) -> None:
        first, *rest = value.expandtabs(8).split("\n")
        self.line.append(first)
        for part in rest:
            self.end_line(keep_empty=True)
            self.line.append(part)

    def _put(self, line: str) -> None:
        if self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        self.lines.append(("".join(self.indents) + line).rstrip())

    def end_line(self, keep_empty: bool = False) -> None:
        line, self.line, self.space = "".join(self.line), [], False
        if line.strip() or keep_empty:
            if self.marker:
                line, self.marker = self.marker + line, ""
                indents, self.indents = self.indents, self.indents[:-1]
                self._put(line)
                self.indents = indents
            else:
                self._put(line)

    def block(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def begin_item(self, marker: str) -> None:
        self.end_line()
        self.indents.append(" " * len(marker))
        self.marker = marker

    def end_item(self) -> None:
        self.end_line()
        if self.marker:
            self.line.append("")
            self.marker = ""
        self.indents.pop()

    def finish(self) -> list[str]:
        self.end_line()
        return self.lines


class Table:
    """Rows of cells; each cell is its lines and its spans."""

    def __init__(self):
        self.rows: list[list[tuple[list[str], int, int]]] = []
        self.caption: list[str] = []

    def lines(self) -> list[str]:
        placed: list[dict[int, list[str]]] = []
        taken: dict[int, int] = {}  # column -> rows that a cell above still covers
        for row in self.rows:
            cells, column = {}, 0
            below = {c: n - 1 for c, n in taken.items() if n > 1}
            for lines, columns, rows in row:
                while taken.get(column, 0) > 0:
                    column += 1
                cells[column] = lines
                if rows > 1:
                    below |= {c: rows - 1 for c in range(column, column + columns)}
                column += columns
            taken = below
            placed.append(cells)
        widths: dict[int, int] = {}
        for cells in placed:
            for column, lines in cells.items():
                width = max(map(len, lines), default=0)
                widths[column] = max(widths.get(column, 0), min(width, WIDEST_COLUMN))
        columns = sorted(widths)
        result = list(self.caption)
        for cells in placed:
            for k in range(max((len(lines) for lines in cells.values()), default=0)):
                parts = []
                for column in columns:
                    lines = cells.get(column, [])
                    parts.append((lines[k] if k < len(lines) else "").ljust(widths[column]))
                result.append(" | ".join(parts).rstrip())
        return result


def attributes_of(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), _unescaped(double or single or bare))
    return found


def _number(value: str, other: int) -> int:
    """The number of an attribute, which may have any number of digits."""
    if not (value.isascii() and value.isdigit()):
        return other
    digits = value.lstrip("0")
    return int(digits or "0") if len(digits) <= 10 else 10**10


def _span(attributes: dict[str, str], name: str) -> int:
    return min(max(_number(attributes.get(name, "1"), 1), 1), 1000)


def _unescaped(text: str) -> str:
    if "&#" in text:
        text = TOO_LARGE.sub("\ufffd", ZEROS.sub("&#", text))
    return unescape(text)


class Element:
    __slots__ = ("name", "shown", "visible", "number", "attributes", "foreign")

    def __init__(self, name, shown, visible, attributes):
        self.name, self.shown, self.visible, self.attributes = name, shown, visible, attributes
        self.number = 0
        self.foreign = False  # its children are of SVG or MathML


class Page:
    """Builds the tree as a stack of open elements and lays out what is visible."""

    def __init__(self):
        self.open: list[Element] = [Element("", True, True, {})]
        self.depths: dict[str, list[int]] = {}  # of the open elements, by name
        self.flows: list[Flow] = [Flow()]
        self.tables: list[Table] = []
        self.pre = 0

    def start(self, name: str, source: str) -> bool:
        """Opens an element; false if its tag closes it at once, as SVG and MathML allow."""
        attributes = attributes_of(source) if source.strip(" /\t\r\n\f") else {}
        if self.open[-1].foreign and name in BREAKS_OUT:
            depth = len(self.open) - 1
            while self.open[depth - 1].foreign:
                depth -= 1
            self._close(depth)
        if name in ENDS_PARAGRAPH:
            self._end_implied(frozenset(["p"]), BORDERS)
        if name in IMPLIED:
            self._end_implied(*IMPLIED[name])
        if name == "body":
            self._end_implied(frozenset(["head"]), frozenset(["body"]))
        elif self.open[-1].name == "head" and name not in (
            "base", "basefont", "bgsound", "link", "meta", "title", "noscript", "style", "script", "template", "noframes",
        ):
            self._close(len(self.open) - 1)
        if name in ("td", "th") and self.tables and self.open[-1].name != "tr":
            self.start("tr", "")
        above = self.open[-1]
        style = dict(STYLE.findall(attributes.get("style", "").lower()))
        root = name in ("svg", "math")
        if above.foreign or root:
            style = {k: attributes[k].lower() for k in ("display", "visibility") if k in attributes} | style
        shown = (
            above.shown
            and name not in HIDDEN
            and not (above.foreign and name in FOREIGN_HIDDEN)
            and "hidden" not in attributes
            and style.get("display") != "none"
            and not (name == "input" and attributes.get("type", "").lower() == "hidden")
            and not (name == "dialog" and "open" not in attributes)
            and not (above.name == "details" and "open" not in above.attributes and name != "summary")
        )
        visible = {"hidden": False, "collapse": False, "visible": True}.get(style.get("visibility", ""), above.visible)
        if above.foreign and name == "mphantom":
            visible = False
        element = Element(name, shown, visible, attributes)
        element.foreign = root or (above.foreign and name not in HOLDS_HTML)
        if shown:
            self._enter(element, above)
        if name not in VOID:
            self.depths.setdefault(name, []).append(len(self.open))
            self.open.append(element)
            if (above.foreign or root) and source.endswith("/"):
                self._close(len(self.open) - 1)
                return False
        return True

    def _enter(self, element: Element, above: Element) -> None:
        name, flow = element.name, self.flows[-1]
        if element.foreign:
            # labels and rows of a matrix stand apart, cells of a row by a space
            if self._is_line(element):
                flow.block(0)
            elif name == "mtd":
                flow.space = True
            return
        if name == "br":
            flow.end_line(keep_empty=not flow.line and bool(flow.lines) and not flow.gap)
        elif name == "table":
            flow.block(1)
            self.tables.append(Table())
        elif name == "tr" and self.tables:
            self.tables[-1].rows.append([])
        elif name in ("td", "th", "caption") and self.tables:
            self.flows.append(Flow())
        elif name == "li":
            flow.block(0)
            if above.name == "ol":
                if not above.number:
                    above.number = _number(above.attributes.get("start", "1"), 1) - 1
                above.number += 1
                flow.begin_item(f"{above.number}. ")
            else:
                flow.begin_item("- ")
        elif name in ("dd", "blockquote"):
            flow.block(1 if name in SPACED else 0)
            flow.indents.append("  ")
        elif name in BLOCKS:
            inside = name in ("ul", "ol", "menu") and bool(self.depths.get("li"))
            flow.block(1 if name in SPACED and not inside else 0)
        if name == "pre":
            self.pre += 1

    @staticmethod
    def _is_line(element: Element) -> bool:
        return element.name in ("text", "mtr") or (
            element.name == "math" and element.attributes.get("display", "").lower() == "block"
        )

    def _leave(self, element: Element) -> None:
        name = element.name
        if element.foreign:
            if self._is_line(element):
                self.flows[-1].block(0)
            return
        if name == "table" and self.tables:
            table = self.tables.pop()
            flow = self.flows[-1]
            flow.block(1)
            for line in table.lines():
                flow.line.append(line)
                flow.end_line()
            flow.block(1)
        elif name in ("td", "th", "caption") and self.tables and len(self.flows) > 1:
            lines = self.flows.pop().finish()
            table = self.tables[-1]
            if name == "caption":
                table.caption += lines
            else:
                if not table.rows:
                    table.rows.append([])
                table.rows[-1].append(
                    (lines, _span(element.attributes, "colspan"), _span(element.attributes, "rowspan"))
                )
        elif name == "li":
            self.flows[-1].end_item()
        elif name in ("dd", "blockquote"):
            self.flows[-1].block(1 if name in SPACED else 0)
            self.flows[-1].indents.pop()
        elif name in BLOCKS:
            inside = name in ("ul", "ol", "menu") and bool(self.depths.get("li"))
            self.flows[-1].block(1 if name in SPACED and not inside else 0)
        if name == "pre":
            self.pre -= 1

    def _close(self, depth: int) -> None:
        while len(self.open) > depth:
            element = self.open.pop()
            self.depths[element.name].pop()
            if element.shown:
                self._leave(element)

    def _last(self, names: frozenset) -> int:
        """Depth of the innermost open element of these names, 0 if there is none."""
        return max((self.depths[n][-1] for n in names if self.depths.get(n)), default=0)

    def _end_implied(self, names: frozenset, borders: frozenset) -> None:
        """Closes the outermost of the named elements above the nearest border."""
        if not any(self.depths.get(n) for n in names):
            return
        border, found = self._last(borders), len(self.open)
        for n in names:
            own = self.depths.get(n)
            if own and own[-1] > border:
                found = min(found, own[bisect_right(own, border)])
        self._close(found)

    def end(self, name: str) -> None:
        if name == "br":
            self.start("br", "")
            return
        own = self.depths.get(name)
        crosses = name in ("table", "tr", "tbody", "thead", "tfoot", "body", "html")
        if own and (crosses or self._last(BORDERS) <= own[-1]):
            self._close(own[-1])

    def text(self, value: str) -> None:
        above = self.open[-1]
        if above.name == "head" and value.strip():
            self._close(len(self.open) - 1)
            above = self.open[-1]
        if not above.shown or not above.visible:
            return
        if above.name in TABLE_PARTS and not above.foreign and not value.strip():
            return
        if above.name == "details" and "open" not in above.attributes:
            return
        if self.pre:
            self.flows[-1].verbatim(value)
        else:
            self.flows[-1].text(value)

    def finish(self) -> str:
        self._close(1)
        return "\n".join(self.flows[0].finish())


def render_page(html: str) -> str:
    """The visible text of a page."""
    page, at, length = Page(), 0, len(html)
    find, last_end = html.find, html.rfind(">")
    while at < length:
        tag = find("<", at)
        if tag < 0:
            tag = length
        if tag > at:
            page.text(_unescaped(html[at:tag]))
        if tag == length:
            break
        if tag > last_end and not html.startswith("<!--", tag):
            page.text(_unescaped(html[tag:]))  # no tag ends any more
            break
        found = MARKUP.match(html, tag) or LOOSE_TAG.match(html, tag)
        if not found:
            page.text("<")
            at = tag + 1
            continue
        if page.open[-1].foreign and html.startswith("<![CDATA[", tag):
            stop = find("]]>", tag)
            at = length if stop < 0 else stop + 3
            page.text(html[tag + 9 : length if stop < 0 else stop])
            continue
        at = found.end()
        if found.lastgroup == "comment":
            short = 1 if html.startswith(">", at) else 2 if html.startswith("->", at) else 0
            stop = COMMENT_END.search(html, at)
            at = at + short if short else stop.end() if stop else length
            continue
        name = found["name"] if "name" in found.groupdict() else None
        if not name:
            continue
        name = name.lower()
        if found["end"]:
            page.end(name)
            continue
        stays = page.start(name, found["attrs"])
        if stays and name in RAW and name not in VOID:
            closing = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
            stop = closing.start() if closing else length
            inner = html[at:stop]
            page.text(_unescaped(inner) if name in ("textarea", "title") else inner)
            page.end(name)
            after = find(">", stop)
            at = length if after < 0 else after + 1
    return page.finish()


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, text."""
    kind = pages.schema[id_col].dataType

    def compute(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [render_page(html.as_py()) for html in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["page_id", "text"])

    schema = T.StructType([T.StructField("page_id", kind), T.StructField("text", T.StringType())])
    html = F.coalesce(F.col(html_col), F.lit(""))
    return pages.select(F.col(id_col).alias("page_id"), html.alias("html")).mapInArrow(compute, schema)
