import gzip
import json

import pytest
from graphloom.llm import html_text, warc
from graphloom.llm.html_text import render
from graphloom.llm.shared import Shelf
from pyarrow import fs

from ..conftest import SMALL, rows_of


def pages(spark):
    rows = [(3, "http://a", "<p>x"), (1, None, "<p>x"), (2, "http://b\r\n", None), (9, "u", ""), (None, "n", "<p>x"), (None, "m", "alone"), (1, None, "<p>x"), (5, "long", "<p>y</p>" * 40_000), (6, "utf", "é中\r\n\r\nWARC/1.1\r\n")]
    return spark.createDataFrame([(*r, "a", 1, "b") for r in rows], "page_id long, url string, html string, payload string, size long, archive string")


def test_op2_odd(spark):
    rows = warc.round_trip(pages(spark)).collect()
    assert len(rows) == 9
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in rows)
    assert got == sorted([(3, 4, "revisit", 1), (1, 4, "response", None), (1, 4, "response", None), (2, 0, "response", None), (9, 0, "revisit", 2), (0, 4, "revisit", 1), (0, 5, "response", None), (5, 320_000, "response", None), (6, 19, "response", None)])
    assert {r.payload_digest for r in rows if r.payload_bytes == 0} == {"3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"}
    for r in rows:
        assert (r.payload is None) == (r.record_type == "revisit") and (r.payload is None or len(r.payload) == r.payload_bytes)
    assert warc.round_trip(pages(spark).where("false")).count() == 0


def test_least_bytes(spark):
    rows = warc.round_trip(pages(spark), least_bytes=5).collect()
    assert {r.record_type for r in rows} == {"response"}


def test_op2_sql(spark, oracle):
    assert rows_of(warc.op2_warc(spark, SMALL)) == oracle(warc.ORACLE)


def test_normalise(tmp_path):
    records = [warc.make_record(k, f"u{k}", b"x" * (k * 700_000), warc.sha1_base32(b"x" * (k * 700_000)), None, False) for k in range(4)]
    (tmp_path / "one.gz").write_bytes(gzip.compress(b"".join(records)))
    index = warc.normalise(fs.LocalFileSystem(), f"{tmp_path}/one.gz", f"{tmp_path}/many.gz")
    data = (tmp_path / "many.gz").read_bytes()
    assert [gzip.decompress(data[x["offset"] : x["offset"] + x["length"]]) for x in index] == records
    assert gzip.decompress(data) == b"".join(records)
    assert [json.loads(x) for x in (tmp_path / "many.gz.idx").read_text().splitlines()] == index
    (tmp_path / "cut.gz").write_bytes(gzip.compress(b"".join(records)[:-5]))
    with pytest.raises(ValueError):
        warc.normalise(fs.LocalFileSystem(), f"{tmp_path}/cut.gz", f"{tmp_path}/no.gz")


def test_rerun_of_a_lost_task(spark, tmp_path):
    shelf, folder = Shelf(spark, "warc-test"), f"file://{tmp_path}"
    names = shelf.keep(warc.write_archives(warc.marked(pages(spark), shelf), folder), "names")
    first = warc.normalise_archives(names, folder, drop=True).collect()
    assert sorted(first) == sorted(warc.normalise_archives(names, folder, drop=True).collect())


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("just text &amp; more", "just text & more"),
        ("<title>t</title><script>var t='</p>'</script><style>p{}</style><p>a<p>b", "a\n\nb"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>", "- a\n- b\n  3. x\n  4. y\n- c"),
        ("<p>one <b>bold<i>, </b>two</i> three<br>four", "one bold, two three\nfour"),
        ("<table><tr><th>Name<th>N<tr><td>long one<td>2<tr><td>s<td>10</table>", "Name      N\nlong one  2\ns         10"),
        ("<table><tr><td>中文<td>x<tr><td>abcde<td>y</table>", "中文   x\nabcde  y"),
        ("<table><tr><td colspan=2>a<td>b<tr><td>c<td>d<td>e</table>", "a     b\nc  d  e"),
        ("a<div hidden>no</div><div style='color:red; display: none'>no</div><span style=visibility:hidden>no</span>b", "ab"),
        ("<pre>  x\n    y</pre>z", "  x\n    y\n\nz"),
        ("<!-- no --><h1>H</h1>text<blockquote>q</blockquote>", "H\n\ntext\n\n> q"),
        ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
        ("a < b <c", "a < b <c"),
        ("<img alt='pic'><img src=x>z", "pic z"),
        ("<p>unclosed <a href='x", "unclosed <a href='x"),
        ("<a title='1 > 0'>x</a><b c=\"'>y</b><i>", "x<b c=\"'>y"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
        ("<table><tr><td><ul><li>a<li>b</ul><td>c<tr><td>d<td>e</table>", "- a  c\n- b\nd    e"),
        ("<table><tr><td>x<td><table><tr><td>aa<td>b<tr><td>c<td>d</table><tr><td>y<td>z</table>", "x  aa  b\n   c   d\ny  z"),
        ("<table><tr><td><pre>a\n  b</pre><td>c</table>", "a    c\n  b"),
        ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>", "yes"),
        ("<textarea>a &lt;b></textarea> <select><option>one<option selected>two</select> <select multiple><option>p<option>q</select>", "a <b>\ntwo\np\nq"),
        ("<input value=go type=submit><input type=hidden value=no><svg><title>no</title><text>yes</text></svg><math><mi>x</mi></math>", "go yesx"),
        ("&#65;&#00066;&#99999999999;&#" + "9" * 6000 + ";", "AB\ufffd\ufffd"),
    ],
)
def test_render(page, text):
    assert render(page) == text


def test_render_survives():
    assert render("<div>" * 30_000 + "x") == "x"
    assert "x" in render("<table><tr><td>" * 300 + "x")
    for junk in ("</p></td></li></table>x", "<td>x", "<tr>x", "<li>x", "<p></p></p>x"):
        assert "x" in render(junk)


def letters(text):
    return sum(len(x) for x in text.split())


@pytest.mark.parametrize(
    "page, most",
    [
        ("<p x='" * 80_000, 2), ("</a " * 800_000, 2), ("<a " * 160_000, 2), ("<a " * 160_000 + "'>", 2), ("<a<a" * 80_000 + "'>", 2), ("<p x='\"" * 40_001 + ">", 2), ("<div>" * 200_000 + "x</p>y", 2), ("<p><div>" * 100_000 + "x", 2),
        ("<p><table><td>" + "<div>" * 100_000 + "x", 2), ("<ul>" + "<div>" * 50_000 + "<li>x" * 50_000, 20), ("<b><td>" + "<div>" * 50_000 + "</b>x" * 50_000, 4),
        ("<table>" + "<tr><td>a<td>" * 50_000 + "b" * 60_000 + "<td>c</table>", 20), ("<table>" + "<tr><td>" + "w" * 200 + "<td>x" * 500 + "<tr><td>y" * 20_000, 20), ("<table><tr>" + "<td colspan=1000>x" * 50_000, 20),
        ("<table><tr>" + "<td rowspan=65534>x" * 20_000 + "<tr><td>y" * 20_000, 20), ("<ul><li>x" * 50_000, 80), ("<blockquote>x" * 50_000, 80), ("<table><tr><td>x" * 20_000, 40), ("<script>" + "</script " * 50_000, 2),
    ],
)
def test_render_is_linear(page, most):
    """Broken and deep pages: in time, and in text of at most ``most`` characters for each letter shown (and a few)."""
    import time

    began = time.process_time()
    text = render(page)
    assert time.process_time() - began < 20 and len(text) <= most * letters(text) + 1000


def test_op3(spark):
    out = {(r.page_id, r.n_chars): r.text for r in html_text.html_text(pages(spark)).collect()}
    assert out[1, 1] == "x" and out[2, 0] == "" and len(out) == 8
    assert html_text.html_text(pages(spark).where("false")).count() == 0
    import re

    words = re.compile(r"\w+").findall
    source = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    import html

    for r in html_text.op3_html_text(spark, SMALL).collect():
        body = re.sub(r"(?s)<head>.*?</head>|<!--.*?-->|<script.*?</script>|<style.*?</style>", " ", source[r.page_id])
        assert words(r.text) == words(html.unescape(re.sub(r"<[^>]*>", " ", body))), r.page_id


def test_nested_selects():
    """Options belong to the nearest select; many levels take time in proportion."""
    import time

    assert render("<select><option>a<option selected>b<table><tr><td><select multiple><option>c<option>d</select></table></select>").split() == ["b", "c", "d"]
    assert render("<select><optgroup><option>a</optgroup><option>b</select><option>c").split() == ["a", "c"]
    began = time.time()
    assert render("<select><option>a<option selected>b<table><td>" * 50_000).split() == ["b"] * 50_000
    assert time.time() - began < 60
