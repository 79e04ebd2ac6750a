"""Rendering of pages against the texts a browser shows."""

import re
import time
from collections import Counter
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm.html_render import extract, render

CASES = [
    ("<p>one<p>two", "one\n\ntwo"),
    ("a<br>b<div>c</div>d", "a\nb\nc\nd"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=3><li>x<li>y</ol>", "3. x\n4. y"),
    ("<table><tr><th>Name<th>Qty<tr><td>apple pie<td>3<tr><td>b<td>44</table>", "Name       Qty\napple pie  3\nb          44"),
    ("<table><tr><td colspan=2>wide one<tr><td>a<td>b</table>", "wide one\na  b"),
    ("<table><td>x</table>after", "x\n\nafter"),
    ("<head><title>no</title></head><body>yes<script>var a='</p>'</script>", "yes"),
    ("<div hidden>no</div><p style='display: none'>no</p>yes", "yes"),
    ("<style>.x{display:none} #y{visibility:hidden}</style><p class='a x'>no</p><p id=y>no<b style='visibility:visible'>yes</b></p>", "yes"),
    ("<pre>  k\n   l</pre>", "  k\n   l"),
    ("<details><summary>S</summary>no</details><details open><summary>T</summary>yes</details>", "S\nT\nyes"),
    ("a &amp; b &copy; &#233; &bogus;", "a & b © é &bogus;"),
    ("<!-- c --><!DOCTYPE html>x<!-- open", "x"),
    ("a  \n b<i> c</i>", "a b c"),
    ("<p>x<table><tr><td>y</table></p>z", "x\n\ny\n\nz"),
    ("<h1>T</h1>text<blockquote>q</blockquote>", "T\n\ntext\n\n  q"),
    ("<dl><dt>k<dd>v</dl>", "k\n  v"),
    ("1 < 2 and <b>bold", "1 < 2 and bold"),
    ("</div></p>x</li>", "x"),
    ("<textarea>t</textarea><select><option>yes<option>no</select>", "t yes"),
    ("<select><option>no<optgroup><option selected>yes</select>", "yes"),
    ("<select multiple><option>a<option>b</select>", "a b"),
    ("x <math><mi>a</mi><mo>+</mo><mn>1</mn><annotation>no</annotation></math>", "x a+1"),
    ("<svg><title>no</title><defs><text>no</text></defs><g/><path d='M0'/><text>label <tspan>one</tspan></text><text>two</text></svg>", "label one two"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>dd<td>e</table>", "a   b\n    c\ndd  e"),
    ("<table><tr><td>a<td rowspan=0>b<td>c<tr><td>d<td>e</table>", "a  b  c\nd     e"),
    ("<style>/* .y{display:none} */ @media print{.x{display:none}} @media screen{.z{display:none}}</style><p class=x>yes<p class=y>too<p class=z>no", "yes\n\ntoo"),
    ("<a title='x>y' href=z>shown</a><b class=\"q\"w>too</b>", "showntoo"),
    ("<p title='never closed>one</p>two", "one\n\ntwo"),
    ("<script>no</scripty>no</SCRIPT x>yes", "yes"),
    ("<!-->shown<!--->too<!-- no --!>end", "showntooend"),
]


@pytest.mark.parametrize("source,text", CASES)
def test_case(source, text):
    assert render(source) == text


def test_deep_and_long():
    assert "end" in render("<div>" * 5000 + "end")
    assert render("<b>" * 3000 + "x") == "x"
    assert len(render("<p>" + "word " * 100_000)) > 400_000
    assert "tail" in render("<a href='" * 1999 + "x'>tail")


BAD = {
    "quotes": "<a " + '"' * 100_000,
    "opened": "<a " * 100_000,
    "styles": "<style>" + "a" * 1_000_000 + "</style>",
    "comments": "<style>" + "/*" * 300_000 + "</style>",
    "spaces": "<a" + " " * 300_000 + "x",
    "equals": "<a " + "= " * 150_000 + ">",
    "braces": "<style>" + "@media x{" * 100_000,
    "brackets": "<" * 300_000,
    "apostrophes": "<a x='" * 100_000,
    "ends": "</p" * 100_000,
    "raw": "<script>" + "</scrip" * 100_000,
}


@pytest.mark.parametrize("name", BAD)
def test_time_grows_with_length_alone(name):
    began = time.perf_counter()
    render(BAD[name])
    assert time.perf_counter() - began < 1


class Words(HTMLParser):
    """A second, plain reading: words outside of elements that are not shown."""

    def __init__(self):
        super().__init__()
        self.hidden, self.found = [], []

    def handle_starttag(self, tag, attrs):
        gone = tag in ("script", "style", "template", "noscript", "head", "title") or "hidden" in dict(attrs) or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", dict(attrs).get("style") or "")
        if tag not in ("br", "img", "hr", "meta", "link", "input") and (gone or self.hidden):
            self.hidden.append(tag)

    def handle_endtag(self, tag):
        if tag in self.hidden:
            del self.hidden[len(self.hidden) - 1 - self.hidden[::-1].index(tag) :]

    def handle_data(self, data):
        if not self.hidden:
            self.found += data.split()


def test_words_of_pages_against_a_plain_reading(spark, small):
    """Every visible word of every page, and nothing but list marks besides."""
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    for r in pages.collect():
        plain = Words()
        plain.feed(r.html or "")
        marks = r"(?m)^\s*(?:-|\d+\.) "
        want, have = Counter("".join(plain.found)), Counter("".join(re.sub(marks, "", got[r.page_id]).split()))
        assert not want - have, r.page_id
        assert sum((have - want).values()) <= 6 * got[r.page_id].count("\n") + 6


@given(st.text(alphabet="<>/pbtdrli ulae\"'=&;!-x\n", max_size=120))
@settings(max_examples=300, deadline=None)
def test_any_source(source):
    render(source)


@given(st.lists(st.text(alphabet="abc", min_size=1, max_size=5), min_size=1, max_size=8))
@settings(max_examples=60, deadline=None)
def test_all_words_are_shown(words):
    tags = ["p", "div", "li", "td", "b", "h2", "section"]
    source = "".join(f"<{tags[i % 7]}>{w} " for i, w in enumerate(words))
    assert render(source).replace("- ", " ").split() == words


def test_table(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    rows = {r.page_id: r.text for r in extract(pages).collect()}
    sources = {r.page_id: r.html for r in pages.collect()}
    assert rows == {i: render(s) for i, s in sources.items()}
    assert all("track(" not in t and "margin:0" not in t and "<p" not in t for t in rows.values())
    odd = spark.createDataFrame([(None, "<p>a", "clash"), (1, None, ""), (1, None, ""), (2, "", "")], "page_id long, html string, text string")
    assert sorted((r.page_id or 0, r.text) for r in extract(odd).collect()) == [(0, "a"), (1, ""), (1, ""), (2, "")]
    assert extract(odd.limit(0)).count() == 0
