import gzip
import random
import re
from base64 import b32encode
from collections import defaultdict
from hashlib import sha1

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from visitlens.llm import warc
from visitlens.llm.html_text import extract_text, render_html

PAGES = [
    (5, "http://a/1?x=1 2", "<p>same</p>"),
    (3, "http://a/2", "<p>same</p>"),
    (9, None, "<p>same</p>"),
    (9, None, "<p>same</p>"),
    (1, "http://a/3", None),
    (2, "http://a/4", ""),
    (7, "http://é/5", "WARC/1.0\r\n\r\nContent-Length: 5\r\n\r\n\r\n\r\nünï\x00"),
    (8, "http://a/6", "x" * 200_000),
]


def test_archives_round_trip(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    rows = warc.archive_pages(df, str(tmp_path / "w")).collect()
    by_payload = defaultdict(list)
    for p, _, h in PAGES:
        by_payload[(h or "").encode()].append(p)
    assert sorted(r.page_id for r in rows) == sorted(p for p, _, _ in PAGES)
    got = {r.page_id: r for r in rows}
    for payload, ids in by_payload.items():
        for p in ids:
            r, first = got[p], min(ids)
            assert r.capture.payload_bytes == len(payload)
            assert r.capture.payload_digest == b32encode(sha1(payload).digest()).decode()
            assert r.capture.record_type == ("response" if p == first else "revisit")
            assert r.capture.refers_to_page == (None if p == first else first)
            assert (r.capture.payload is None) == (p != first)
            assert r.request.id and r.metadata.id
    assert got[7].capture.payload == PAGES[6][2]
    assert sorted(r["n"] for r in warc.read_records(spark, str(tmp_path / "w")).groupBy("type").count().withColumnRenamed("count", "n").collect()) == [4, 4, 8, 8]


def test_each_row_is_a_capture(spark, tmp_path):
    pages = [(None, "u", "same"), (None, "u", "same"), (4, "v", "same"), (2, "a", "twice"), (2, "b", "twice"), (2, "b", "twice"), (3, "c", "twice"), (None, None, None), (6, "big", "<p>\r\n\r\n\r\n\r\n</p>" * 100_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' as sha1", "1 as row", "2 as first", "3 as value")
    rows = warc.archive_pages(df.repartition(3), str(tmp_path / "w")).collect()
    assert len(rows) == len(pages) and len({r.capture.id for r in rows}) == len(pages)
    kinds = sorted(((r.page_id, r.capture.record_type, r.capture.refers_to_page, r.capture.payload_bytes) for r in rows), key=str)
    assert kinds == sorted([(None, "response", None, 4), (None, "response", None, 4), (4, "revisit", None, 4), (2, "response", None, 5), (2, "response", None, 5), (2, "response", None, 5), (3, "revisit", 2, 5), (None, "response", None, 0), (6, "response", None, 1_500_000)], key=str)
    responses = {r.capture.id for r in rows if r.capture.record_type == "response"}
    assert all(r.capture.refers_to in responses for r in rows if r.capture.record_type == "revisit")
    assert sorted(r.capture.target for r in rows if r.page_id == 2) == ["a", "b", "b"]


def test_archives_of_others(spark, tmp_path):
    def record(head, block):
        return b"WARC/1.1\r\n" + head + b"\r\ncontent-length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"

    page = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n\xff\xfe no utf-8"
    found = record(b"WARC-TYPE: warcinfo\r\nwarc-record-id:<urn:1>", b"software: x") + record(b"WARC-Type: response\r\nWARC-Record-ID: <urn:2>\r\nContent-Type: application/http\r\nWARC-Payload-Digest: sha1:WRONG", page) + record(b"WARC-Type: request\r\nWARC-Record-ID: <urn:3>\r\nWARC-Concurrent-To: <urn:2>\r\nContent-Type: application/http", b"") + record(b"WARC-Type: metadata\r\nWARC-Record-ID: <urn:4>\r\nWARC-Concurrent-To: <urn:2>", b"page_id: not a number\r\nflag")
    (tmp_path / "a.txt").write_bytes(found)
    with gzip.open(tmp_path / "b.txt.gz", "wb") as f:
        f.write(found.replace(b"<urn:", b"<urn:b"))
    rows = warc.transactions(warc.read_records(spark, str(tmp_path))).collect()
    assert sorted((r.page_id, r.capture.id, r.capture.intact, r.capture.payload_bytes, r.request.id) for r in rows) == [(None, "<urn:2>", False, 11, "<urn:3>"), (None, "<urn:b2>", False, 11, "<urn:b3>")]
    with pytest.raises(Exception, match="cut short"):
        (tmp_path / "c.txt").write_bytes(found[:-30])
        warc.read_records(spark, str(tmp_path)).collect()


def foreign(records):
    """Archives as others write them: the bytes of (id, payload) responses, one by one."""
    return [b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:%d>\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\nHTTP/1.1 200 OK\r\n\r\n" % (i, b32encode(sha1(p).digest()), len(p) + 19) + p + b"\r\n\r\n" for i, p in records]


def test_any_name_and_plain_archives_of_many_splits(spark, tmp_path):
    r = random.Random(3)
    bits = [b"\r\n", b"\r\n\r\n", b"\n", b"\r", b"WARC/1.0\r\n", b"Content-Length: 3", b"a", b"\x00\xff", b"<p>text</p>" * 20, b""]
    payloads = [b"".join(r.choices(bits, k=r.randint(0, 30))) for _ in range(900)] + [b"x" * 100_000, b"\r\n" * 30_000]
    records = foreign(enumerate(payloads))
    (tmp_path / "crawl-1.warc").write_bytes(b"".join(records[:450] + records[900:]))
    (tmp_path / "other").write_bytes(b"".join(records[450:600]))
    (tmp_path / "members.warc.gz").write_bytes(b"".join(map(gzip.compress, records[600:750])))
    (tmp_path / "one.gz").write_bytes(gzip.compress(b"".join(records[750:900])))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = warc.read_records(spark, str(tmp_path)).select("id", "intact", "payload_bytes").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.id, r.intact, r.payload_bytes) for r in rows) == sorted((f"<urn:{i}>", True, len(p)) for i, p in enumerate(payloads))


def test_folders_without_archives_are_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="no archives"):
        warc.read_records(spark, str(tmp_path))
    (tmp_path / "notes.md").write_text("no archive")
    with pytest.raises(Exception, match="no WARC record"):
        warc.read_records(spark, str(tmp_path)).collect()
    (tmp_path / "notes.md").write_bytes(foreign([(1, b"abc")])[0][:-9])
    with pytest.raises(Exception, match="cut short"):
        warc.read_records(spark, str(tmp_path)).collect()


def test_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_pages(df, str(tmp_path / "e")).count() == 0
    assert extract_text(df).count() == 0


def text(html):
    return render_html(html)[1]


def test_blocks_and_implied_tags():
    assert text("<p>one<p>two <b>bold</b>\n  text<div>three</div>four") == "one\n\ntwo bold text\n\nthree\nfour"
    assert text("a<br>b<br><br>c") == "a\nb\n\nc"
    assert text("<h1>T</h1><pre>  x\n   y</pre>z") == "T\n\n  x\n   y\n\nz"
    assert text("<blockquote>q<p>r</blockquote>s") == "  q\n\n  r\n\ns"


def test_visibility():
    html = "<html><head><title>T &amp; t</title><style>p{}</style><script>var a='</p>';</script></head><body>a<span hidden>b</span><i style='display: none'>c</i><b aria-hidden=true>d</b><noscript>e</noscript>f<!-- g --></body></html>"
    assert render_html(html)[:2] == ("T & t", "adf")


def test_lists():
    assert text("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == "- a\n- b\n\n  - c\n\n- d" or text("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == "- a\n- b\n\n  - c\n- d"
    assert text("<ol start=9><li>a<li>b</ol>") == "9. a\n10. b"


def test_tables():
    html = "<table><caption>C</caption><tr><th>name<th>n<tr><td>a long one<td>1<tr><td>b<td>22</table>"
    assert text(html) == "C\nname        n\na long one  1\nb           22"
    assert text("<table><td>x<td>y</table>") == "x  y"
    assert text("<table><tr><td colspan=2>ab<td>c<tr><td>1<td>2<td>3</table>") == "ab     c\n1   2  3"
    assert text("<table><tr><td rowspan=2>ab<td>c<tr><td>d<tr><td>e<td>f</table>") == "ab  c\n    d\ne   f"
    assert text("<table><tr><td colspan=99999999999>ab<td>c<tr><td>d<td>e</table>") == "ab     c\nd   e"
    assert text("<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c</tbody><tr><td>d<td>e</table>") == "a  b\n   c\nd  e"
    assert text(f"<table><tr><td colspan={'9' * 5000}>a<td rowspan={'9' * 5000}>b<tr><td>c</table>") == "a  b\nc"


def test_broken_pages_never_fail():
    for html in ["", "<", "</p></div>", "<table><tr><td>" * 300, "<div>" * 5000 + "x", "<p", "<!DOCTYPE html>", "&#x110000; &bogus;", "<ol start=x><li>a", "<![CDATA[x]]>", "<ul>" * 150 + "<li>x", "<![ foo", "a<![if IE]>b", "<![x[", "<!", "</", "<!x", "<?", "<table>" * 600]:
        render_html(html)
    assert text("<div>" * 5000 + "deep") == "deep"
    assert text("a<![ foo>b<![endif]-->c") == "abc"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", ">", "!", "[", "]", "/", "-", "?", "CDATA", "table", "tr", "td", "p", "div", "li", "ul", "svg", "textarea", "select", "head", "script", "style", " ", "x", "=", '"', "&", "colspan", "9", "<p>", "<td>", "</table>", "\x00", "é"]), max_size=30))
def test_any_string_is_rendered(parts):
    render_html("".join(parts))


def tree(r, depth=0):
    """Random nested markup and, from its making alone, the words that show, in order."""
    html, words = "", []
    for _ in range(r.randint(1, 4)):
        kind = r.choice(["word", "word", "p", "div", "b", "ul", "table", "hidden", "script", "comment"]) if depth < 5 else "word"
        word = "w" + "".join(r.choices("abcdefgh", k=9))
        if kind == "word":
            html, words = f"{html} {word} ", [*words, word]
        elif kind in ("p", "div", "b"):
            inner, own = tree(r, depth + 1)
            html, words = f"{html}<{kind}>{inner}</{kind}>", words + own
        elif kind == "ul":
            items = [tree(r, depth + 1) for _ in range(r.randint(1, 3))]
            html += "<ul>" + "".join(f"<li>{h}" + r.choice(["", "</li>"]) for h, _ in items) + "</ul>"
            words = words + [w for _, own in items for w in own]
        elif kind == "table":
            cells = [[("w" + "".join(r.choices("abcdefgh", k=r.randint(3, 9)))) for _ in range(r.randint(1, 4))] for _ in range(r.randint(1, 3))]
            html += "<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in row) for row in cells) + "</table>"
            words = words + [c for row in cells for c in row]
        else:
            html += {"hidden": f"<div hidden>{tree(r, depth + 1)[0]}</div>", "script": f"<script>{word}</script>", "comment": f"<!-- {word} -->"}[kind]
    return html, words


def test_all_visible_words_come_out_in_order(spark):
    r = random.Random(12)
    made = [tree(r) for _ in range(400)]
    rows = extract_text(spark.createDataFrame([(i, h) for i, (h, _) in enumerate(made)], "page_id long, html string")).collect()
    assert len(rows) == len(made)
    for row in rows:
        assert re.findall(r"w[a-h]+", row.text) == made[row.page_id][1], made[row.page_id][0]


def test_pages_edges(spark):
    long = "<p>para <b>bold</b>" * 100_000
    data = [(None, None), (None, None), (1, ""), (2, "<p>same"), (2, "<p>same"), (3, long)]
    df = spark.createDataFrame(data, "page_id long, html string").selectExpr("*", "'x' as title", "'y' as text", "1 as n_blocks")
    rows = extract_text(df).collect()
    assert sorted([(r.page_id, r.text) for r in rows if r.page_id != 3], key=str) == sorted([(None, ""), (None, ""), (1, ""), (2, "same"), (2, "same")], key=str)
    assert [r.n_blocks for r in rows if r.page_id == 3] == [100_000]


def test_a_head_ends_at_what_cannot_stand_in_it():
    assert render_html("<html><head><title>T</title>Hello <a href=x>world</a> again<p>para")[:2] == ("T", "Hello world again\n\npara")
    assert render_html("<head><title>T</title><meta charset=utf-8><script>var a</script>\n<a href=x>only</a> inline")[:2] == ("T", "only inline")
    assert text("<head><style>p{}</style><noscript>n</noscript><template>t</template>\n</head>b") == "b"


def test_form_fields_drawings_and_fallbacks_are_shown():
    assert text("<p>a <textarea>\nb  c\nd</textarea>") == "a b  c\nd"
    assert text("<select><optgroup label=G><option>one<option selected>two</select> x") == "G one two x"
    assert text("<svg><title>t</title><defs><text>no</text></defs>stray<g><text>yes</text><text>also</text></g></svg>") == "yes also"
    assert text("<object>fallback</object><object data=x.swf>no</object>") == "fallback"


def test_hidden_text_stays_hidden_at_any_depth():
    for n in (5, 199, 509, 510, 511, 512, 513, 514, 800):
        deep = "<div>" * n
        assert text(deep + "a<script>s</script><style>t</style><i hidden>u<i>v</i>w</i>b") == "ab", n
        assert text(f"{deep}a<div hidden>{'<div>' * 250}x{'</div>' * 250}y</div>b") == "ab", n
