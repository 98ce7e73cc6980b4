"""Layout-aware text of HTML pages.

A tree builder with implied tags reads the page; a renderer walks the tree and emits
all visible text: blocks on lines of their own, a blank line around paragraphs,
headings, lists and tables, list items with their marks and indents, preformatted
text as it is, and table cells padded to aligned columns.

Pages nest as deep as they like: open elements are found by their tags' places, and the
renderer keeps its own stack but for lists, tables and quotes. Indents stop growing after
``MOST_INDENTS`` levels; no text is lost there.

Visibility: nothing of head, script, style, template, noscript and other elements without
text of their own is shown, nor svg but for its ``text`` and ``foreignObject``, nor the
definitions, descriptions and annotations in svg and math, nor elements with the ``hidden`` attribute, with ``display: none`` or
``visibility: hidden`` in their style (``visibility: visible`` inside shows again), or
in rules of ``style`` elements for a tag, class, id or several of these together (other
selectors and at-rules are not read), closed ``details`` but for the summary, closed ``dialog``, and hidden inputs. Comments
are never text.

Defined cases: a null page gives a null text, an empty one an empty text; broken
markup is read to its end; repeated rows and null ids are returned each; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.shared import in_batches, table

MOST_INDENTS = 256
MOST_COLUMNS = 1000  # the largest colspan that HTML allows

# fixed values: element kinds of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript iframe object audio video canvas datalist base link meta title param source track area progress meter".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr menu".split())
BLOCK = SPACED | frozenset(
    "address article aside body center dd details dialog dir div dt fieldset figcaption footer form header hgroup html legend li main nav optgroup option search section summary tr td th thead tbody tfoot caption".split()
)
CLOSES_P = SPACED | frozenset("address article aside center details dialog dir div dd dt fieldset figcaption footer form header hgroup li main nav search section summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: an opening tag closes these open ones, up to the nearest of the second set
IMPLIED_END = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset("select datalist".split())),
    "optgroup": (frozenset("option optgroup".split()), frozenset(["select"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "tr": (frozenset("tr td th caption".split()), frozenset(["table"])),
    "thead": (frozenset("thead tbody tfoot tr td th caption".split()), frozenset(["table"])),
    "tbody": (frozenset("thead tbody tfoot tr td th caption".split()), frozenset(["table"])),
    "tfoot": (frozenset("thead tbody tfoot tr td th caption".split()), frozenset(["table"])),
    "caption": (frozenset("thead tbody tfoot tr td th caption".split()), frozenset(["table"])),
}
#: an end tag doesn't reach through these to an element outside them
SCOPE = frozenset("table td th caption html template".split())
ROW_GROUPS = frozenset("thead tbody tfoot".split())
SCOPE_PASSERS = ROW_GROUPS | frozenset("table tr body html".split())
#: elements that hold rows and cells only, the tags that open a part of a table, and all that stays where it is in one
TABLE_PARTS = ROW_GROUPS | {"table", "tr"}
STRUCTURE = ROW_GROUPS | frozenset("caption colgroup tr td th".split())
IN_TABLE = STRUCTURE | frozenset("col form script style template".split())
#: in svg and math: what is never drawn in its place, and where HTML goes on
FOREIGN_UNSEEN = frozenset("defs metadata desc annotation annotation-xml symbol clippath mask pattern marker".split())
HTML_INSIDE = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
#: in math: elements whose children stand apart
APART = frozenset("mfrac mtable mtr mlabeledtr".split())
#: HTML tags that end an open svg or math
BREAK_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
_BLANK = re.compile(r"[ \t\n\r\f]+")
_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([a-z-]+)", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)\b", re.I)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_SIMPLE = re.compile(r"([a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)")


class Element:
    __slots__ = ("attributes", "children", "ruled", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes = tag, attributes
        self.children: list[Element | str] = []
        self.ruled: tuple[str, str] = ("", "")  # display and visibility that the page's rules give it


class Open:
    """The open elements, from the root on, with the places of each tag."""

    def __init__(self, root: Element):
        self.elements = [root]
        self.places: dict[str, list[int]] = defaultdict(list)

    def push(self, e: Element) -> None:
        self.places[e.tag].append(len(self.elements))
        self.elements.append(e)

    def cut(self, at: int) -> None:
        """Close the element at ``at`` and all in it; the root stays."""
        while len(self.elements) > max(1, at):
            self.places[self.elements.pop().tag].pop()

    def nearest(self, tags: Iterable[str]) -> int:
        """The innermost open element with one of the tags; 0 for none."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def outermost(self, tags: Iterable[str], above: int) -> int:
        """The outermost open element with one of the tags inside the one at ``above``; 0 for none."""
        found = [p[k] for t in tags if (p := self.places.get(t)) and (k := bisect_right(p, above)) < len(p)]
        return min(found, default=0)


def style_rules(sheet: str) -> list[tuple[tuple[int, int], str, frozenset[str], str, str]]:
    """Rank, tag, classes and ids, display and visibility of the sheet's rules whose selector is simple and that say either."""
    rules, at, text = [], 0, _COMMENT.sub(" ", sheet)
    while (brace := text.find("{", at)) >= 0:
        selector = text[at:brace].strip().rsplit(";", 1)[-1].strip()
        end = text.find("}", brace)
        if selector.startswith("@"):  # with all in it
            depth, end = 1, brace + 1
            while depth and end < len(text):
                depth += {"{": 1, "}": -1}.get(text[end], 0)
                end += 1
            at = end
            continue
        body = text[brace + 1 : end if end >= 0 else len(text)]
        at = end + 1 if end >= 0 else len(text)
        said = [found[1].lower() if (found := last) else "" for last in (_last(_DISPLAY, body), _last(_VISIBILITY, body))]
        if any(said):
            for one in selector.split(","):
                if (simple := _SIMPLE.fullmatch(one.strip())) and one.strip():
                    marks = frozenset(re.findall(r"[.#][\w-]+", simple[2]))
                    rank = (sum(m[0] == "#" for m in marks) * 1000 + len(marks) * 10 + bool(simple[1]), len(rules))
                    rules.append((rank, (simple[1] or "").lower(), marks, *said))
    return sorted(rules)


def _last(pattern: re.Pattern, body: str) -> re.Match | None:
    found = None
    for found in pattern.finditer(body):
        pass
    return found


class TreeBuilder(HTMLParser):
    """Builds the element tree; end tags and table rows that a page leaves out are put in."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("html", {})
        self.opened = Open(self.root)
        self.open = self.opened.elements
        self.any_foreign = False  # an svg or math was opened
        self.depth = 1
        self.elements: list[Element] = []
        self.sheets: list[str] = []

    def _foreign(self) -> int:
        """The open svg or math whose rules hold here; 0 in HTML, also in that inside svg and math."""
        if not self.any_foreign:
            return 0
        at = self.opened.nearest(("svg", "math"))
        return at if at > self.opened.nearest(HTML_INSIDE) else 0

    def _unseen_text(self) -> bool:
        """Whether text here is in an svg but in no text or HTML of it."""
        at = self._foreign()
        return at > 0 and self.open[at].tag == "svg" and self.opened.nearest(("text",)) < at

    def _pop_to(self, at: int) -> None:
        self.opened.cut(at)

    def _close(self, tags: frozenset[str], stop: frozenset[str]) -> None:
        """Close the outermost of the open elements in ``tags`` above the nearest in ``stop``."""
        if found := self.opened.outermost(tags, self.opened.nearest(stop)):
            self._pop_to(found)

    def _push(self, tag: str, attributes: dict[str, str], keep_open: bool = True) -> None:
        element = Element(tag, attributes)
        self._insert(element)
        self.elements.append(element)
        if keep_open:
            self.opened.push(element)
            self.depth = max(self.depth, len(self.open))

    def _context(self) -> int:
        """The nearest open part of a table, cell or caption; 0 if there is none."""
        return self.opened.nearest(TABLE_PARTS | SCOPE)

    def _insert(self, node: Element | str) -> None:
        """Add to the open element; what has no place in a table goes before the table."""
        at = len(self.open) - 1
        if self.open[at].tag in TABLE_PARTS and (node.strip() if isinstance(node, str) else node.tag not in IN_TABLE):
            while at and self.open[at].tag != "table":
                at = at - 1 if self.open[at].tag in TABLE_PARTS else 0
            if at:
                outside = self.open[at - 1].children  # an open table is the last of them
                outside.insert(len(outside) - 1, node)
                return
        self.open[-1].children.append(node)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._start(tag, attrs)

    def _start(self, tag: str, attrs: list[tuple[str, str | None]], ended: bool = False) -> None:
        """``ended``: the tag closes itself, which only svg, math and what is in them can."""
        attributes = {k: v or "" for k, v in reversed(attrs)}
        at = self._foreign()
        while at and tag in BREAK_OUT:
            self._pop_to(at)
            at = self._foreign()
        if at:
            if tag in FOREIGN_UNSEEN:
                attributes["hidden"] = ""
            if tag == "text" or self.open[-1].tag in APART:
                self._insert(" ")
            return self._push(tag, attributes, not ended)
        if tag in ("svg", "math"):
            self.any_foreign = True
        if tag in ("html", "body"):
            self._close(frozenset(["head"]), frozenset())
            if tag == "html":
                return
        elif tag not in UNSEEN and len(self.open) == 2 and self.open[1].tag == "head":
            self._pop_to(1)  # content ends the head
        if self.open[-1].tag == "colgroup" and tag not in ("col", "template"):
            self._pop_to(len(self.open) - 1)
        if tag in CLOSES_P:
            self._close(frozenset(["p"]), SCOPE | {"button"})
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self._pop_to(len(self.open) - 1)
        if tag in IMPLIED_END:
            self._close(*IMPLIED_END[tag])
        if tag in STRUCTURE or tag == "table":
            at = self._context()
            if self.open[at].tag in TABLE_PARTS:
                self._pop_to(at + 1)  # stray elements end where the table goes on
                if tag == "table":  # directly in another: that one ends
                    self._close(frozenset(TABLE_PARTS), SCOPE - {"table"})
        if tag in ("td", "th") and self.open[-1].tag != "tr" and self.opened.nearest(("table",)):
            self._push("tr", {})
        ended = ended and tag in ("svg", "math")
        self._push(tag, attributes, tag not in VOID and not ended and not (tag == "form" and self.open[-1].tag in TABLE_PARTS))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._start(tag, attrs, True)

    def handle_endtag(self, tag: str) -> None:
        if tag == "text" and self.any_foreign and self._foreign():
            self._insert(" ")
        if tag in VOID:
            if tag == "br":
                self._push("br", {}, False)
            return
        at = self.opened.nearest((tag,))
        if at and (tag in SCOPE_PASSERS or at >= self.opened.nearest(SCOPE)):
            return self._pop_to(at)
        if tag == "p":
            self._push("p", {}, False)

    def handle_data(self, data: str) -> None:
        if len(self.open) == 2 and self.open[1].tag == "head" and data.strip():
            self._pop_to(1)
        if self.open[-1].tag == "colgroup" and data.strip():
            self._pop_to(len(self.open) - 1)
        if self.open[-1].tag == "style":
            self.sheets.append(data)
        if self.any_foreign and self._unseen_text():
            return
        self._insert(data)

    def apply_rules(self) -> None:
        """Give each element what the page's style rules say of it, the strongest and then the last one first."""
        by_tag, by_mark = defaultdict(list), defaultdict(list)
        for rule in style_rules("".join(self.sheets)):
            _, tag, marks, _, _ = rule
            if marks:
                by_mark[min(marks)].append(rule)
            else:
                by_tag[tag].append(rule)
        for e in self.elements if by_tag or by_mark else ():
            own = {f".{c}" for c in e.attributes.get("class", "").split()} | {f"#{x}" for x in [e.attributes.get("id", "")] if x}
            met = [*by_tag[e.tag], *(r for m in own if m in by_mark for r in by_mark[m] if r[2] <= own and r[1] in ("", e.tag))] if own or e.tag in by_tag else []
            for _, _, _, display, visibility in sorted(met):
                e.ruled = (display or e.ruled[0], visibility or e.ruled[1])


def parse(page: str) -> tuple[Element, int]:
    """The root of a page's tree, and how deep it is."""
    builder = TreeBuilder()
    builder.feed(page)
    builder.close()
    if builder.sheets:
        builder.apply_rules()
    return builder.root, builder.depth


def width(text: str) -> int:
    """Columns that a text takes: two for wide characters, none for combining ones."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Lines:
    """Collects text as lines: inline text runs on, blocks break, blanks collapse."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.parts: list[str] = []
        self.blank = False  # a blank is due before the next inline text
        self.gap = False  # an empty line is due before the next line

    def inline(self, text: str) -> None:
        words = _BLANK.split(text)
        if len(words) > 1 and not words[0]:
            self.blank = True
        for word in words:
            if word:
                if self.blank and self.parts:
                    self.parts.append(" ")
                self.parts.append(word)
                self.blank = True
        self.blank = len(words) > 1 and not words[-1] or (self.blank and not any(words))

    def literal(self, lines: list[str]) -> None:
        """Whole lines, as they are."""
        self.end()
        if lines:
            self._space()
            self.done += lines

    def _space(self) -> None:
        if self.gap and self.done:
            self.done.append("")
        self.gap = False

    def end(self, spaced: bool = False) -> None:
        """End the line; ``spaced``: an empty line follows, once there is more."""
        if self.parts:
            self._space()
            self.done.append("".join(self.parts))
            self.parts = []
        self.blank = False
        self.gap = self.gap or spaced

    def line_break(self) -> None:
        if self.parts:
            self.end()
        else:
            self._space()
            self.done.append("")


def _shown(e: Element, visible: bool) -> tuple[bool, bool]:
    """Whether an element takes part in the layout, and whether text in it shows."""
    if e.tag in UNSEEN or "hidden" in e.attributes or (e.tag == "dialog" and "open" not in e.attributes):
        return False, False
    display, visibility = e.ruled
    style = e.attributes.get("style", "")
    if style:
        if found := _last(_DISPLAY, style):
            display = found[1].lower()
        if found := _last(_VISIBILITY, style):
            visibility = found[1].lower()
    if display == "none":
        return False, False
    return True, visibility == "visible" if visibility else visible


def _children(e: Element) -> list[Element | str]:
    if e.tag == "details" and "open" not in e.attributes:
        return [c for c in e.children if isinstance(c, Element) and c.tag == "summary"][:1]
    return e.children


def _number(text: str, default: int, least: int = 1, most: int = MOST_COLUMNS) -> int:
    found = re.match(r"\s*([+-]?\d{1,9})", text)
    return min(most, max(least, int(found[1]))) if found else default


def _preformatted(e: Element, visible: bool, out: list[str]) -> None:
    stack = [(iter(_children(e)), visible)]
    while stack:
        children, visible = stack[-1]
        c = next(children, None)
        if c is None:
            stack.pop()
        elif isinstance(c, str):
            if visible:
                out.append(c)
        elif c.tag == "br":
            out.append("\n")
        else:
            shown, seen = _shown(c, visible)
            if shown:
                stack.append((iter(_children(c)), seen))


def _list(e: Element, visible: bool, lines: Lines, depth: int) -> None:
    number = _number(e.attributes.get("start", ""), 1, -(10**9), 10**9)
    for c in e.children:
        if isinstance(c, str):
            if visible:
                lines.inline(c)
            continue
        shown, seen = _shown(c, visible)
        if not shown:
            continue
        if c.tag != "li":
            _walk([c], visible, lines, depth)
            continue
        mark = "- "
        if e.tag == "ol":
            number = _number(c.attributes.get("value", ""), number, -(10**9), 10**9)
            mark = f"{number}. "
            number += 1
        item = Lines()
        _content(c, seen, item, depth + 1)
        item.end()
        if item.done:
            indent = " " * len(mark) if depth < MOST_INDENTS else ""
            lines.literal([mark + item.done[0], *(indent + x if x else x for x in item.done[1:])] if indent else [mark + item.done[0], *item.done[1:]])


def _rows(e: Element, visible: bool) -> Iterator[tuple[Element, bool]]:
    """Rows of a table in display order: head, bodies, foot."""
    groups: dict[str, list[tuple[Element, bool]]] = {"thead": [], "tbody": [], "tfoot": []}
    for c in e.children:
        if isinstance(c, Element):
            shown, seen = _shown(c, visible)
            if not shown:
                continue
            if c.tag == "tr":
                groups["tbody"].append((c, seen))
            elif c.tag in ROW_GROUPS:
                for r in c.children:
                    if isinstance(r, Element) and r.tag == "tr":
                        row_shown, row_seen = _shown(r, seen)
                        if row_shown:
                            groups[c.tag].append((r, row_seen))
    for name in ("thead", "tbody", "tfoot"):
        yield from groups[name]


def _table(e: Element, visible: bool, lines: Lines, depth: int) -> None:
    for c in e.children:  # captions, and content that has no place in a table, come before it
        if isinstance(c, str):
            if visible and c.strip():
                lines.inline(c)
        elif c.tag not in ROW_GROUPS and c.tag not in ("tr", "col", "colgroup"):
            _walk([c], visible, lines, depth)
    lines.end()
    grid: list[dict[int, list[str]]] = []
    spans: dict[int, int] = {}  # columns taken by cells of earlier rows: rows left
    spanning: list[tuple[int, int, int, list[str]]] = []
    for r, (row, row_seen) in enumerate(_rows(e, visible)):
        cells: dict[int, list[str]] = {}
        column = 0
        taken = {c for c, n in spans.items() if n > 0}
        spans = {c: n - 1 for c, n in spans.items() if n > 1}
        for c in row.children:
            if not isinstance(c, Element) or c.tag not in ("td", "th"):
                continue
            shown, seen = _shown(c, row_seen)
            if not shown:
                continue
            while column in taken:
                column += 1
            wide = _number(c.attributes.get("colspan", ""), 1)
            high = _number(c.attributes.get("rowspan", ""), 1, 1, 65534)
            inner = Lines()
            _content(c, seen, inner, depth + 1)
            inner.end()
            if wide > 1:
                spanning.append((r, column, wide, inner.done))
            else:
                cells[column] = inner.done
            if high > 1:
                spans.update(dict.fromkeys(range(column, column + wide), high - 1))
            taken.update(range(column, column + wide))
            column += wide
        grid.append(cells)
    widths: dict[int, int] = {}
    for cells in grid:
        for c, text in cells.items():
            widths[c] = max([widths.get(c, 0), *map(width, text)])
    for r, c, _, text in spanning:
        grid[r][c] = text
    columns = sorted({c for cells in grid for c in cells})
    starts, at = {}, 0
    for c in columns:
        starts[c] = at
        at += widths.get(c, 0) + (3 if widths.get(c, 0) else 0)
    for cells in grid:
        for k in range(max(map(len, cells.values()), default=0)):
            line, reach = "", 0
            for c in sorted(cells):
                if k < len(cells[c]) and cells[c][k]:
                    if line:
                        pad = max(starts[c] - 3 - reach, 0)
                        line, reach = line + " " * pad + " | ", reach + pad + 3
                    elif starts[c]:
                        line, reach = " " * starts[c], starts[c]
                    line, reach = line + cells[c][k], reach + width(cells[c][k])
            lines.literal([line.rstrip()])


def _content(e: Element, visible: bool, lines: Lines, depth: int) -> None:
    _walk(_children(e), visible, lines, depth)


def _walk(nodes: list[Element | str], visible: bool, lines: Lines, depth: int) -> None:
    """Render nodes one after the other; plain elements in them are opened on a stack, with how their line ends."""
    stack: list[tuple[Iterator[Element | str], bool, bool | None]] = [(iter(nodes), visible, None)]
    while stack:
        children, visible, spaced = stack[-1]
        c = next(children, None)
        if c is None:
            stack.pop()
            if spaced is not None:
                lines.end(spaced)
        elif isinstance(c, str):
            if visible:
                lines.inline(c)
        else:
            shown, seen = _shown(c, visible)
            if not shown:
                continue
            if c.tag in APART_ELEMENTS:
                _element(c, seen, lines, depth)
            elif c.tag in BLOCK:
                lines.end(c.tag in SPACED)
                stack.append((iter(_children(c)), seen, c.tag in SPACED))
            else:
                stack.append((iter(_children(c)), seen, None))


#: elements with a layout of their own
APART_ELEMENTS = frozenset("br input pre ul ol menu dir table blockquote dd".split())


def _element(e: Element, visible: bool, lines: Lines, depth: int) -> None:
    if e.tag == "br":
        return lines.line_break()
    if e.tag == "input":
        if visible and e.attributes.get("type", "text").lower() in ("submit", "reset", "button", "text", "search", "email", "url", "tel", "number"):
            lines.inline(e.attributes.get("value", ""))
        return None
    spaced = e.tag in SPACED and not (depth and e.tag in ("ul", "ol"))
    if e.tag in BLOCK:
        lines.end(spaced)
    if e.tag == "pre":
        out: list[str] = []
        _preformatted(e, visible, out)
        text = "".join(out).replace("\r\n", "\n").replace("\r", "\n").removeprefix("\n")
        lines.literal(text.rstrip("\n").split("\n") if text.strip() else [])
    elif e.tag in ("ul", "ol", "menu", "dir"):
        _list(e, visible, lines, depth)
    elif e.tag == "table":
        _table(e, visible, lines, depth)
    else:
        inner = Lines()
        _content(e, visible, inner, depth + 1)
        inner.end()
        lines.literal([f"  {x}" if x else x for x in inner.done] if depth < MOST_INDENTS else inner.done)
    lines.end(spaced)
    return None


def page_text(page: str | None) -> str | None:
    """All visible text of a page."""
    if page is None:
        return None
    lines = Lines()
    root, depth = parse(page)
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 6 * depth + 1000))
    shown, seen = _shown(root, True)
    if shown:
        _content(root, seen, lines, 0)
    lines.end()
    while lines.done and not lines.done[-1]:
        lines.done.pop()
    while lines.done and not lines.done[0]:
        lines.done.pop(0)
    return "\n".join(lines.done)


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` and the visible text of each page."""
    source = pages.select(*keep, html)
    kinds = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [page_text(x.as_py()) for x in part.column(html)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(texts, pa.string())], [*keep, "text"])

    return in_batches(source, run, f"{kinds}, text string")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op1_html_extraction": op1_html_extraction}
