"""HTML to text by layout-aware rendering.

A small tree builder reads tags with the implied ends and starts that pages rely on (a new paragraph
ends the open one, a row ends the open row and cell, body and head need no tags: a head ends at the first text or tag
that can't stand in it), then visibility rules drop
what a browser would not show, and the rest is rendered: blocks stand on lines of their own with a blank line
around paragraphs, lists are marked and indented, and the cells of a table are padded to columns, over the columns and rows
that they span; columns without text take no room.

Time and output are linear in the page, whatever it holds. Layout is the same for all pages and loses no text: a table that would be
wider than WIDTH has its widest columns wrapped at spaces (words stay whole, and what is longer than its column moves the rest of its line),
cells that would begin beyond WIDTH follow at two blanks, a table in a cell has half the room, and one with less than NARROW has a
row's cells one after another; lists and quotations indent by INDENT columns at most.

Defined results: null and empty html give an empty text; repeated rows and rows without an id each give a row. Unclosed, stray and
broken tags never fail: an unknown declaration is a comment. As in browsers, elements nest to a depth of DEPTH and further ones are
siblings: all text stays, and hidden ones keep hidden what they hold. What is hidden from screen readers alone is shown. A tag, a
comment or a script that never ends reaches to the end of the page. Rows beneath know of row spans in the first MOST_COLUMNS columns. Text
areas keep their lines, all options of a select are shown, an svg shows its text elements, and an object without data its
fallback. Rows are rendered one by
one; columns beyond page_id and html are ignored.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections import Counter, defaultdict
from heapq import heappop, heappush
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: How deep browsers nest elements, and the HTML standard's limits of spans.
DEPTH = 512
MOST_COLUMNS, MOST_ROWS = 1000, 65534
#: Layout, in characters: a table's room, the room below which a table isn't aligned, the least room of a column that is wrapped, and the deepest indentation.
WIDTH, NARROW, COLUMN, INDENT = 100, 8, 8, 40
RESULT = "page_id long, title string, text string, n_blocks long, n_hidden long"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = {"head", "script", "style", "template", "noscript", "title", "datalist", "audio", "video", "canvas", "iframe", "noframes", "noembed"}
#: What may stand in a head.
HEAD = {"base", "basefont", "bgsound", "head", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}
#: Within an svg: what holds its text, and what is never drawn where it stands.
DRAWN, UNDRAWN = {"text", "foreignobject"}, {"defs", "symbol", "desc", "metadata", "clippath", "mask", "pattern", "marker"}
LOOSE = {"p", "blockquote", "pre", "ul", "ol", "dl", "table", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr"}
BLOCK = LOOSE | {"html", "body", "div", "article", "section", "main", "nav", "header", "footer", "aside", "address", "li", "dt", "dd", "tr", "form", "fieldset", "figcaption", "details", "summary", "caption", "thead", "tbody", "tfoot", "center", "td", "th"}
CELLS, ROWS = {"td", "th"}, {"thead", "tbody", "tfoot"}
#: An opening tag ends these open elements, up to (not into) these.
ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", *CELLS, "caption"}, {"table"}), "td": (CELLS, {"tr", "table"}), "th": (CELLS, {"tr", "table"}),
    "option": ({"option"}, {"select"}), **{t: ({"tr", *CELLS, *ROWS, "caption"}, {"table"}) for t in ROWS},
}
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)|opacity\s*:\s*0(?:\.0*)?\s*(?:;|$)", re.I)


class Node:
    __slots__ = ("tag", "attrs", "inside", "hidden")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.inside = tag, attrs, []
        self.hidden = tag in HIDDEN or "hidden" in attrs or (tag == "input" and attrs.get("type") == "hidden") or (tag == "object" and bool(attrs.get("data"))) or bool(HIDING.search(attrs.get("style") or ""))


# ---- tags ----------------------------------------------------------------------------------

#: Elements whose inside is text up to their own end tag, with and without character references.
RAW, REFERRING = {"script", "style", "xmp", "iframe", "noembed", "noframes"}, {"textarea", "title"}
NAME = re.compile(r"[^\s/>]+")
ATTRIBUTE = re.compile(r"[\s/]*(?:(=?[^\s/>=]*)(\s*=\s*)?)")
BARE = re.compile(r"[^\s>]*")
ZEROS, BEYOND = re.compile(r"(&#)0+(?=[0-9])|(&#[xX])0+(?=[0-9a-fA-F])"), re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{7,});?")
COMMENT_END = re.compile(r"--!?>")


def plain_text(text: str) -> str:
    """Text with its character references replaced; numbers beyond Unicode are U+FFFD, however long."""
    if "&#" in text:
        text = BEYOND.sub("\ufffd", ZEROS.sub(lambda m: m[1] or m[2], text))
    return unescape(text)


def tag_at(html: str, i: int) -> tuple[int, str, dict[str, str | None], bool]:
    """The tag whose name begins at ``i``: where it ends (beyond the page if it never does), name, attributes (the first of a name), and whether it closes itself."""
    name = NAME.match(html, i)
    i, attrs, n = name.end(), {}, len(html)
    while i < n:
        m = ATTRIBUTE.match(html, i)
        key, i = m[1], m.end()
        value = None
        if m[2]:
            quote = html[i : i + 1]
            if quote in ("'", '"') and quote:
                end = html.find(quote, i + 1)
                if end < 0:
                    break
                value, i = html[i + 1 : end], end + 1
            else:
                bare = BARE.match(html, i)
                value, i = bare[0], bare.end()
        if key and key.lower() not in attrs:
            attrs[key.lower()] = value and plain_text(value)
        if html.startswith(">", i):
            return i + 1, name[0].lower(), attrs, m[2] is None and html[i - 1] == "/"
    return n + 1, name[0].lower(), attrs, False


def tokens(html: str):
    """(kind, name or text, attributes) in the order of the page; each character is looked at a fixed number of times."""
    n, i, since = len(html), 0, 0

    def letter(at: int) -> bool:
        return html[at : at + 1].isalpha() and html[at].isascii()

    while True:
        i = html.find("<", i)
        if i < 0:
            break
        start = i
        if letter(i + 1):
            i, name, attrs, closed = tag_at(html, i + 1)
            found = ("empty" if closed else "start", name, attrs) if i <= n else None
        elif html.startswith("</", i) and letter(i + 2):
            i, name, attrs, closed = tag_at(html, i + 2)
            found = ("end", name, attrs) if i <= n else None
        elif html.startswith("<!--", i):
            # "<!-->" and "<!--->" are comments as well
            short = next((k for k in (">", "->") if html.startswith(k, i + 4)), None)
            end = None if short else COMMENT_END.search(html, i + 4)
            i, found = (i + 4 + len(short)) if short else end.end() if end else n, None
        elif html[i + 1 : i + 2] in ("!", "?") and i + 1 < n or html.startswith("</", i) and i + 2 < n:
            end = html.find(">", i + 2)
            i, found = end + 1 if end >= 0 else n, None
        else:
            i += 1  # a mark that is text
            continue
        if start > since:
            yield "text", plain_text(html[since:start]), None
        since = i
        if found:
            yield found
            if found[0] == "start" and found[1] in RAW | REFERRING:
                end = re.compile(rf"</{found[1]}(?=[\s/>])", re.I | re.A).search(html, i)
                i = end.start() if end else n
                if i > since:
                    yield "text", plain_text(html[since:i]) if found[1] in REFERRING else html[since:i], None
                since = i
    if since < n:
        yield "text", plain_text(html[since:]), None


# ---- tree ----------------------------------------------------------------------------------


class Builder:
    """Tags to a tree, with implied ends and starts. Where the open elements of each name stand is kept, so that no tag walks through them."""

    def __init__(self):
        self.root = Node("html", {})
        self.open = [self.root]
        self.places: dict[str, list[int]] = defaultdict(list)  # of the open elements of a name
        self.blocks: list[int] = []  # places of the open blocks
        self.flat = Counter()  # tags of elements within the last open one that stand open beyond DEPTH

    def build(self, html: str) -> Node:
        for kind, name, attrs in tokens(html):
            if kind == "text":
                self.text(name)
            elif kind == "end":
                self.end(name)
            else:
                self.start(name, attrs)
                if kind == "empty" and name not in VOID and name not in ("html", "body"):
                    self.end(name)
        return self.root

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close_to(self, ends: set[str], upto: set[str]) -> None:
        if any(self.flat[t] for t in upto):
            return
        floor, lowest = self.last(upto), len(self.open)
        for t in ends:
            places = self.places.get(t) or ()
            k = bisect_right(places, floor)
            if k < len(places):
                lowest = min(lowest, places[k])
        if lowest < len(self.open):
            self.close_at(lowest)

    def close_at(self, i: int) -> None:
        for node in reversed(self.open[i:]):
            self.places[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()
        del self.open[i:]
        self.flat.clear()

    def start(self, tag: str, attrs: dict[str, str | None]) -> None:
        if tag in ("html", "body"):
            self.close_to({"head"}, set())
            return
        if tag in ENDS:
            self.close_to(*ENDS[tag])
        elif tag in BLOCK:
            self.close_to({"p"}, {"td", "th", "li", "div", "table", "button", "object"})
        if self.open[-1].tag == "head" and tag not in HEAD or tag in BLOCK and self.places.get("head"):
            self.close_to({"head"}, set())
        if tag in CELLS and self.open[-1].tag in {"table", *ROWS}:
            self.push(Node("tr", {}))
        node = Node(tag, attrs)
        if tag in VOID:
            self.open[-1].inside.append(node)
        elif len(self.open) > DEPTH and (self.open[-1].hidden or not node.hidden):
            self.open[-1].inside.append(node)
            self.flat[tag] += 1
        else:
            self.push(node)

    def push(self, node: Node) -> None:
        self.open[-1].inside.append(node)
        self.places[node.tag].append(len(self.open))
        if node.tag in BLOCK:
            self.blocks.append(len(self.open))
        self.open.append(node)
        self.flat.clear()

    def end(self, tag: str) -> None:
        if self.flat[tag]:
            self.flat[tag] -= 1
            return
        place = self.last((tag,))
        # an end tag reaches no further than the table around it, and one of an inline element no further than its block
        if place and (tag in ("table", "html", "body") or place > self.last(("table",))) and (tag in BLOCK or not self.blocks or place > self.blocks[-1]):
            self.close_at(place)

    def text(self, data: str) -> None:
        if self.open[-1].tag == "head" and data.strip():
            self.close_to({"head"}, set())
        self.open[-1].inside.append(data)


# ---- layout --------------------------------------------------------------------------------


class Lines:
    """Lines of blocks; a gap is the number of blank lines that the next block asks for. Marked and indented blocks are opened and closed, so that each line is made once."""

    def __init__(self):
        self.lines: list[str] = []
        self.fixed: set[int] = set()  # lines that must not be wrapped
        self.now: list[str] = []
        self.verbatim = False
        self.gap = self.lead = 0  # blank lines asked for within the innermost open block, and before it
        self.rest = ""  # the indentation of all open blocks
        self.marks: list[tuple[str, str]] = []  # of blocks without a line yet: the indentation around them, and their mark
        self.around: list[tuple[int, int, int, str]] = []
        self.start = 0

    def put(self, text: str, verbatim: bool = False) -> None:
        if verbatim:
            first, *rest = text.split("\n")
            self.now.append(first)
            self.verbatim = True
            for x in rest:
                self.end(keep=True)
                self.now.append(x)
                self.verbatim = True
            return
        text = re.sub(r"[ \t\n\r\f]+", " ", text)
        if text.startswith(" ") and (not self.now or self.now[-1].endswith(" ")):
            text = text[1:]
        if text:
            self.now.append(text)

    def end(self, gap: int = 0, keep: bool = False) -> None:
        line = "".join(self.now).rstrip()
        if line or keep:
            if self.lines:
                self.lines += [""] * (self.lead + self.gap)
            before = self.marks[0][0] + "".join(m for _, m in self.marks) if self.marks else self.rest
            self.marks.clear()
            if self.verbatim:
                self.fixed.add(len(self.lines))
            self.lines.append((before + line).rstrip())
            self.gap = self.lead = 0
        self.now, self.verbatim = [], False
        self.gap = max(self.gap, gap) if len(self.lines) > self.start else 0

    def enter(self, first: str, rest: str) -> None:
        """A block whose first line is marked and whose others are indented."""
        self.end()
        self.around.append((self.start, self.lead, self.gap, self.rest))
        self.marks.append((self.rest, first))
        self.start, self.lead, self.gap = len(self.lines), self.lead + self.gap, 0
        if len(self.rest) + len(rest) <= INDENT:
            self.rest += rest

    def leave(self) -> None:
        self.end()
        silent = len(self.lines) == self.start
        self.start, self.lead, gap, self.rest = self.around.pop()
        self.gap = gap if silent else 0
        if silent:
            self.marks.pop()
        else:
            self.lead = 0


class Renderer:
    def __init__(self):
        self.hidden = 0
        self.room = WIDTH

    def render(self, node: Node, out: Lines, pre: bool = False) -> None:
        for x in node.inside:
            if isinstance(x, str):
                out.put(x, pre)
            elif x.hidden:
                self.hidden += 1
            else:
                self.element(x, out, pre)

    def element(self, x: Node, out: Lines, pre: bool) -> None:
        tag, gap = x.tag, int(x.tag in LOOSE)
        if tag == "br":
            out.end(keep=True)
        elif tag == "img":
            out.put(x.attrs.get("alt") or "")
        elif tag == "textarea":
            if x.inside and isinstance(x.inside[0], str):
                x.inside[0] = x.inside[0].removeprefix("\n")
            self.render(x, out, True)
        elif tag in ("select", "optgroup", "option"):
            out.put(" ")
            out.put(x.attrs.get("label") or "" if tag == "optgroup" else "")
            self.render(x, out)
            out.put(" ")
        elif tag == "svg":
            self.drawing(x, out)
        elif tag == "hr":
            out.end(1)
            out.put("---")
            out.end(1)
        elif tag in ("ul", "ol", "dl"):
            out.end(gap)
            self.items(x, out)
            out.end(gap)
        elif tag == "table":
            out.end(gap)
            (self.table if self.room >= NARROW else self.stream)(x, out)
            out.end(gap)
        elif tag in BLOCK:
            out.end(gap)
            if tag in ("blockquote", "dd"):
                out.enter("  ", "  ")
            self.render(x, out, pre or tag == "pre")
            if tag in ("blockquote", "dd"):
                out.leave()
            out.end(gap)
        else:
            self.render(x, out, pre)

    def drawing(self, x: Node, out: Lines) -> None:
        for y in x.inside:
            if isinstance(y, str):
                continue
            if y.hidden or y.tag in UNDRAWN:
                self.hidden += 1
            elif y.tag in DRAWN:
                out.put(" ")
                self.render(y, out)
                out.put(" ")
            else:
                self.drawing(y, out)

    def items(self, x: Node, out: Lines) -> None:
        start = x.attrs.get("start") or "1"
        number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
        for item in x.inside:
            if isinstance(item, str) or item.hidden:
                self.hidden += not isinstance(item, str)
                if isinstance(item, str) and item.strip():
                    out.put(item)
                    out.end()
                continue
            if item.tag != "li":
                self.element(item, out, False)
                continue
            mark = f"{number}. " if x.tag == "ol" else "- "
            number += 1
            out.enter(mark, " " * len(mark))
            self.render(item, out)
            out.leave()

    def stream(self, x: Node, out: Lines) -> None:
        """A table without room for columns: a row's cells one after another."""
        for y in x.inside:
            if isinstance(y, str):
                out.put(y)
            elif y.hidden:
                self.hidden += 1
            elif y.tag in CELLS:
                out.put(" ")
                self.render(y, out)
                out.put(" ")
            elif y.tag == "tr" or y.tag in ROWS:
                out.end()
                self.stream(y, out)
                out.end()
            else:
                self.element(y, out, False)

    def cell(self, x: Node, whole: bool = False) -> list[tuple[str, bool]]:
        """A cell's lines with text, or a caption's, and whether they may be wrapped."""
        inner, room = Lines(), self.room
        self.room //= 2
        (self.element if whole else self.render)(x, inner, False)
        inner.end()
        self.room = room
        return [(line, i not in inner.fixed) for i, line in enumerate(inner.lines) if line or whole]

    def table(self, x: Node, out: Lines) -> None:
        """Rows of cells, each column as wide as its widest cell; a cell of several lines makes its row so high."""
        rows: list[dict[int, list[tuple[str, bool]]]] = []
        taken, ends = 0, []  # columns (bits) that cells of the rows above still fill, and the rows where that ends
        number = 0

        def row_of(node: Node) -> None:
            nonlocal taken, number
            while ends and ends[0][0] <= number:
                taken &= ~heappop(ends)[1]
            cells, at, above = {}, 0, taken
            for c in node.inside:
                if isinstance(c, str) or c.hidden:
                    self.hidden += not isinstance(c, str)
                    if not isinstance(c, str) or not c.strip():
                        continue
                    lines, wide, high = [(" ".join(c.split()), True)], 1, 1
                else:
                    lines = self.cell(c)
                    wide, high = span(c, "colspan", MOST_COLUMNS), span(c, "rowspan", MOST_ROWS)
                free = ~(above >> at)
                at += (free & -free).bit_length() - 1
                cells[at] = lines
                if high > 1 and at < MOST_COLUMNS:
                    filled = ((1 << min(at + wide, MOST_COLUMNS)) - (1 << at)) & ~taken
                    if filled:
                        taken |= filled
                        heappush(ends, (number + high, filled))
                at += wide
            number += 1
            if cells:
                rows.append(cells)

        def walk(node: Node) -> None:
            nonlocal taken
            for y in node.inside:
                if isinstance(y, str):
                    if y.strip():
                        rows.append({0: [(" ".join(y.split()), True)]})
                elif y.hidden:
                    self.hidden += 1
                elif y.tag == "tr":
                    row_of(y)
                elif y.tag in ROWS:
                    walk(y)
                    taken = 0
                    ends.clear()
                else:
                    rows.extend({0: [line]} for line in self.cell(y, whole=True))

        walk(x)
        aligned = [row for row in rows if len(row) > 1 or min(row) > 0]
        most = fitting(widest(aligned), self.room)
        for row in aligned:
            for i, lines in row.items():
                row[i] = [part for line in lines for part in wrapped(line, most)]
        starts, start = {}, 0
        for i, wide in sorted(widest(aligned, most).items()):
            starts[i] = min(start, self.room)
            start += wide + 2
        for row in rows:
            alone = len(row) == 1 and min(row) == 0
            cells, k = sorted(row.items()), 0
            while cells := [c for c in cells if len(c[1]) > k]:
                parts, size = [], 0
                for i, lines in cells:
                    text = lines[k][0]
                    if text:
                        blanks = 0 if alone else max(starts[i] - size, 2 * bool(parts))
                        parts.append(" " * blanks + text)
                        size += blanks + len(text)
                out.put("".join(parts), verbatim=True)
                out.verbatim = not (alone and cells[0][1][k][1])
                out.end()
                k += 1


def widest(rows: list[dict[int, list[tuple[str, bool]]]], most: int | None = None) -> dict[int, int]:
    """The longest line of each column, of those no longer than ``most``; columns without text are left out."""
    found: dict[int, int] = {}
    for row in rows:
        for i, lines in row.items():
            for text, _ in lines:
                size = len(text) if most is None or len(text) <= most else most
                found[i] = max(found.get(i, 0), size)
    return found


def fitting(widths: dict[int, int], room: int) -> int | None:
    """How wide columns may be for the table to have the room, None if all may stay."""
    left = room - 2 * (len(widths) - 1)
    if sum(widths.values()) <= left:
        return None
    sizes = sorted(widths.values())
    for k, size in enumerate(sizes):  # columns narrower than an equal share leave theirs to the others
        share = left // (len(sizes) - k)
        if size > share:
            return max(share, COLUMN)
        left -= size
    return None


def wrapped(line: tuple[str, bool], most: int | None) -> list[tuple[str, bool]]:
    text, free = line
    if most is None or len(text) <= most or not free:
        return [line]
    parts, now, size = [], [], -1
    for word in text.split(" "):
        if now and size + 1 + len(word) > most:
            parts.append(" ".join(now))
            now, size = [], -1
        now.append(word)
        size += 1 + len(word)
    return [(part.rstrip(), True) for part in [*parts, " ".join(now)] if part.strip()]


def span(cell: Node, name: str, most: int) -> int:
    digits = re.match(r"[ \t\n\r\f]*\+?0*(\d{0,6})", cell.attrs.get(name) or "", re.A)[1]
    n = int(digits or 0)
    if name == "rowspan" and n == 0 and "0" in (cell.attrs.get(name) or ""):
        return most  # to the end of the rows' group
    return min(max(n, 1), most)


def render_html(html: str) -> tuple[str, str, int, int]:
    """Title, visible text, number of lines with text, and number of hidden elements."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 40 * DEPTH))
    root = Builder().build(html)
    out, renderer = Lines(), Renderer()
    renderer.render(root, out)
    out.end()
    stack, title = [root], ""
    while stack:
        node = stack.pop()
        if node.tag == "title":
            title = " ".join("".join(x for x in node.inside if isinstance(x, str)).split())
            break
        stack += [x for x in reversed(node.inside) if isinstance(x, Node)]
    return title, "\n".join(out.lines).strip("\n"), sum(bool(x) for x in out.lines), renderer.hidden


def _rendered(batches):
    for batch in batches:
        found = [render_html(h or "") for h in batch.column("html").to_pylist()]
        columns = list(zip(*found, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True))], names=["page_id", "title", "text", "n_blocks", "n_hidden"])


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per page: title, visible text, its lines with text, hidden elements."""
    prepare(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(_rendered, RESULT)
