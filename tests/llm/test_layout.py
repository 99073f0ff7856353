"""Layout of pages against a second renderer that works bottom-up, and hostile pages: time and output linear in the page."""

import random
import textwrap
import time

import pytest

from visitlens.llm.html_text import INDENT, WIDTH, render_html


def text(html):
    return render_html(html)[1]


# ---- a second renderer, of trees instead of tags ---------------------------------------------


def made(r, depth=0):
    """A random list of nodes: (kind, inside)."""
    nodes = []
    for _ in range(r.randint(1, 4)):
        kind = r.choice(["word", "word", "word", "bold", "p", "div", "h2", "quote", "ul", "ol", "table", "hidden", "hr"]) if depth < 4 else "word"
        if kind in ("word", "hidden"):
            nodes.append((kind, "".join(r.choices("abcdefgh", k=r.randint(1, 12)))))
        elif kind == "bold":
            nodes.append((kind, ["".join(r.choices("abc", k=3)) for _ in range(r.randint(1, 3))]))
        elif kind in ("ul", "ol"):
            nodes.append((kind, [made(r, depth + 1) for _ in range(r.randint(1, 3))]))
        elif kind == "table":
            most = r.choice([3, 12, 40])
            nodes.append((kind, [[" ".join("".join(r.choices("xyz", k=r.randint(1, 14))) for _ in range(r.randint(1, most))) for _ in range(r.randint(1, 14))] for _ in range(r.randint(1, 4))]))
        else:
            nodes.append((kind, made(r, depth + 1) if kind != "hr" else []))
    return nodes


def markup(nodes, r):
    html = ""
    for kind, inside in nodes:
        if kind == "word":
            html += f" {inside}\n "
        elif kind == "hidden":
            html += f"<div hidden><p>{inside}</div>"
        elif kind == "bold":
            html += f" <b>{' '.join(inside)}</b> "
        elif kind in ("ul", "ol"):
            html += f"<{kind}>" + "".join(f"<li>{markup(x, r)}" + r.choice(["", "</li>"]) for x in inside) + f"</{kind}>"
        elif kind == "table":
            html += "<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in row) for row in inside) + "</table>"
        elif kind == "hr":
            html += "<hr>"
        else:
            tag = "blockquote" if kind == "quote" else kind
            html += f"<{tag}>{markup(inside, r)}</{tag}>"
    return html


def columns(rows):
    aligned = [row for row in rows if len(row) > 1]
    natural = [max(len(row[i]) for row in aligned if i < len(row)) for i in range(max(map(len, aligned), default=0))]
    room = WIDTH - 2 * (len(natural) - 1)
    most = next((c for c in range(max(natural, default=0), 8, -1) if sum(min(w, c) for w in natural) <= room), 8)
    cells = [[textwrap.wrap(c, most, break_long_words=False, break_on_hyphens=False) if len(row) > 1 and most < max(natural) else [c] for c in row] for row in rows]
    starts, at = [], 0
    for i in range(len(natural)):
        starts.append(min(at, WIDTH))
        at += 2 + max(min(most, len(line)) for row in cells if len(row) > 1 and i < len(row) for line in row[i])
    found = []
    for row in cells:
        for k in range(max(map(len, row))):
            line = ""
            for i, lines in enumerate(row):
                if k < len(lines):
                    line = line.ljust(max(starts[i], len(line) + 2 if line else 0)) + lines[k] if len(row) > 1 else lines[k]
            found.append(line)
    return found


def flow(nodes):
    """Blank lines asked for before, lines, and blank lines asked for after."""
    lead, lines, gap, inline = 0, [], 0, []

    def emit(block):
        nonlocal gap, lead
        if block:
            if lines:
                lines.extend([""] * gap)
            else:
                lead = gap
            lines.extend(block)
            gap = 0

    def flush():
        emit([" ".join(inline)] if inline else [])
        inline.clear()

    for kind, inside in nodes:
        if kind == "word":
            inline.append(inside)
        elif kind == "bold":
            inline += inside
        elif kind != "hidden":
            flush()
            loose = int(kind != "div")
            gap = max(gap, loose)
            if kind in ("ul", "ol"):
                for i, item in enumerate(inside):
                    mark = f"{i + 1}. " if kind == "ol" else "- "
                    own = flow(item)[1]
                    emit([((" " * len(mark) if k else mark) + x).rstrip() for k, x in enumerate(own)])
            elif kind == "table":
                emit(columns(inside))
            elif kind == "hr":
                emit(["---"])
            else:
                before, own, after = flow(inside)
                if kind == "quote":
                    emit([("  " + x).rstrip() for x in own])
                else:
                    gap = max(gap, before)
                    emit(own)
                    gap = max(gap, after)
            gap = max(gap, loose)
    flush()
    return (lead if lines else gap), lines, gap


def test_layout_is_that_of_a_second_renderer():
    r = random.Random(5)
    for _ in range(1500):
        nodes = made(r)
        # a paragraph ends where a block begins, so those hold words alone
        nodes = plain_paragraphs(nodes)
        assert text(markup(nodes, r)) == "\n".join(flow(nodes)[1]), nodes


def plain_paragraphs(nodes):
    found = []
    for kind, inside in nodes:
        if kind in ("p", "h2"):
            inside = [x for x in inside if x[0] in ("word", "bold")]
        elif kind in ("ul", "ol"):
            inside = [plain_paragraphs(x) for x in inside]
        elif kind in ("div", "quote"):
            inside = plain_paragraphs(inside)
        found.append((kind, inside))
    return found


# ---- literal layouts --------------------------------------------------------------------------


def test_wide_tables_are_wrapped_and_lose_no_text():
    words = " ".join(f"word{i}" for i in range(200))
    found = text(f"<table><tr><td>{words}<td>b<tr><td>a<td>c</table>")
    lines = found.split("\n")
    assert max(map(len, lines)) <= WIDTH and sorted(found.split()) == sorted([*words.split(), "a", "b", "c"])
    assert lines[0].index(" b") == lines[-1].index(" c")


def test_tables_in_cells_stay_aligned():
    assert text("<table><tr><td>x<td><table><tr><td>long one<td>1<tr><td>b<td>22</table><tr><td>yy<td>z</table>") == "x   long one  1\n    b         22\nyy  z"
    deep = "<table><tr><td>a<td>" * 40 + "end"
    assert text(deep).split() == ["a"] * 40 + ["end"]


def test_indentation_is_bounded():
    found = text("<blockquote>" * 100 + "a<br>b" + "</blockquote>" * 100 + "c").split("\n")
    assert [x.strip() for x in found if x.strip()] == ["a", "b", "c"] and found[1] == " " * INDENT + "b"


def test_tags_as_browsers_read_them():
    assert text("a<!-->b<!--->c<!-- x --!>d</>e</ x>f<? y >g") == "abcdefg"
    assert text("1 < 2 <3 a<b and <") == "1 < 2 <3 a"
    assert text("a<p title='x>y' class=\"q\" data-x = 1/>b<br/>c") == "a\n\nb\nc"
    assert text("<img alt='a &amp; b'> &lt;i&gt; &#x41;&#0066;&#" + "9" * 6000 + ";") == "a & b <i> AB�"
    assert text("a<script>if (a<b) '</p>' </scripty></SCRIPT >b<style><!-- </style>c") == "abc"
    assert render_html("<title>a<b>&amp;</title>x")[:2] == ("a<b>&", "x")
    assert text("a<!-- never closed <p>b") == text("a<i hidden='<p>b") == text("a<script>b") == "a"


# ---- hostile pages ----------------------------------------------------------------------------

HOSTILE = {
    "a long cell over short rows": lambda n: "<table><tr><td>" + "x y " * n + "<td>b" + "<tr><td>a<td>b" * n,
    "a long word over short rows": lambda n: "<table><tr><td>" + "x" * n + "<td>b" + "<tr><td>a<td>b" * n,
    "spans of rows and columns": lambda n: "<table>" + "<tr><td colspan=1000 rowspan=65534>a" * n,
    "spans of rows": lambda n: "<table>" + "<tr><td rowspan=65534>a" * n,
    "many cells": lambda n: "<table><tr>" + "<td>a" * n,
    "far columns": lambda n: "<table><tr>" + "<td>a" * 1000 + "<tr><td colspan=999>a<td>b" * n,
    "many cells beside a high one": lambda n: "<table><tr>" + "<td>a" * n + "<td>" + "a<br>" * n,
    "open tags": lambda n: "<a " * n, "open values": lambda n: '<a b="' * n, "open comments": lambda n: "<!--" * n,
    "open scripts": lambda n: "<script>" * n, "marks": lambda n: "<" * n, "digits": lambda n: "&#" + "9" * n + ";",
    "a long style around many": lambda n: "<div style='" + " display" * n + "'>" + "<b>x" * n,
    "nested quotations": lambda n: "<blockquote>" * 500 + "a<br>" * n,
    "nested lists": lambda n: "<ul><li>" * 250 + "a<br>" * n,
    "nested tables": lambda n: "<table><tr><td>b<td>" * 150 + "a<br>" * n,
    "blocks at the greatest depth": lambda n: "<p><div>" + "<b>" * 505 + "<section>" * n,
    "ends of nothing": lambda n: "<b>" * 505 + "</i>" * n,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_are_linear(name):
    page = HOSTILE[name](20_000)
    began = time.process_time()
    found = render_html(page)[1]
    assert time.process_time() - began < 10  # some tenths of a second to a second; the square would take minutes
    assert len(found) <= 40 * len(page)
    assert found.count("a") + found.count("x") <= page.count("a") + page.count("x")
