"""Main text of pages: made-up layouts, the template of the driver's pages, broken and odd pages."""

import html
import os
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import html_text
from tessera.llm.html_text import main_text

SF = "/root/testdata/sf0.001"
ONE = "The first paragraph of the article, which is long enough, has commas, and says something about its subject."
TWO = "A second paragraph, no shorter than the first, goes on with the story, as paragraphs of articles do."
NOISE = "Buy these shoes now, they are cheap, they are good, they are blue, and they will be gone tomorrow, so hurry, hurry, hurry."
MENU = '<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>'


def test_an_article_among_everything_else():
    page = f"""<!DOCTYPE html><html><head><title>No</title><style>p{{a:b}}</style><script>var x = "<p>no</p>";</script></head><body class="has-sidebar">
    <header><h1>Site</h1><p>{NOISE}</p></header>{MENU}<div id="cookie-notice" role="alert"><p>{NOISE}</p></div>
    <main><article class="post"><header><h2>Title &amp; more</h2><p>By me</p></header><p>{ONE}</p>
    <div class="ad-slot">{NOISE}</div><p>{TWO}<span class="advert">{NOISE}</span></p><p>Short.</p><ul><li>One item</li><li>Another</li></ul>
    <form><p>{NOISE}</p><input name=q></form><section class="comments"><article class="comment"><p>{NOISE} {NOISE}</p></article></section>
    <footer>Shared by</footer></article><aside><p>{NOISE}</p></aside></main><div class="sidebar"><p>{NOISE}</p></div><footer><p>{NOISE}</p></footer>"""
    assert main_text(page) == "\n\n".join(["Title & more", ONE, TWO, "Short.", "One item", "Another"])


def test_layouts_without_semantic_elements():
    page = f"""<body><div id=top class="menu"><a href=/>Home</a> <a href=/x>X</a></div><div class=with-sidebar><div class="entry-content"><h1>Title</h1>
    <p>{ONE}<p>{TWO}<p>Tiny<blockquote>Quoted words</blockquote>loose text<p><a href=/ref>{ONE}</a></div><div class=sidebarLeft>{NOISE}<p>{NOISE}</div></div>
    <div id=commentList><p>{NOISE}<p>{NOISE}<p>{NOISE}</div></body>"""
    assert main_text(page) == "\n\n".join(["Title", ONE, TWO, "Tiny", "Quoted words", "loose text", ONE])
    halves = f"<body><div><div><p>{ONE}</p><p>{TWO}</p></div><div><p>{TWO}</p></div></div>{MENU}</body>"
    assert main_text(halves) == "\n\n".join([ONE, TWO, TWO])
    wrapped = f"<body><form action=x><div><p>{ONE}</p><p>{TWO}</p><p>{ONE}</p></div></form></body>"
    assert main_text(wrapped) == "\n\n".join([ONE, TWO, ONE])
    links = f'<article><p>{ONE}</p><ul><li><a href="/1">One of them</a><li><a href="/2">Another one</a></ul><p>{TWO}</p></article>'
    assert main_text(links) == f"{ONE}\n\n{TWO}"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<html></html>", ""), (f"<body>{MENU}<footer>x</footer>", ""), ("plain words", "plain words"),
        ("<p>a<b>b<i>c</p><p>d", "abc\n\nd"), ("<p>a <3 b &lt; c &notit; &#x41;&#66 &am", "a <3 b < c ¬it; AB &am"), ("<p>x<br>y  z\n\tw", "x y z w"),
        ("<p>a<!-- <p>no</p> -->b<!--", "ab"), ('<p title="a>b">x</p><p title="never closed', "x"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"),
        ("<article><h1>T</h1></article>", "T"), ("<p>a</x></div></p>b", "a\n\nb"), ("<article><p>a<script>x</p>", "a"), ("<div hidden><p>no</p></div><p>yes</p>", "yes"),
        ('<p>a<span class="ad">no<p>b', "a\n\nb"), ("<P CLASS=x>A</P><DIV STYLE='display: none'>no</DIV>", "A"),
    ],
)
def test_small_pages(page, text):
    assert main_text(page) == text


def test_long_and_deep_pages():
    many = "".join(f"<p>Paragraph {k}, of many.</p>" for k in range(20_000))
    assert main_text(f"<article>{many}</article>").count("\n\n") == 19_999
    assert main_text("<div>" * 50_000 + "<p>deep" + "<li>" * 10_000) == "deep"
    assert main_text("<a " * 100_000) == "" and main_text("<p>" + "<" * 100_000).count("<") == 100_000
    assert len(main_text("<p>" + "word " * 1_000_000)) == 4_999_999


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_every_page_of_the_given_tables(spark):
    """Brute force by the template that the given pages follow: the headline and the paragraphs of the article."""
    want = {}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        want[r.page_id] = (r.url, "\n\n".join(b for b in blocks if b))
    got = {r.page_id: (r.url, r.text) for r in html_text.query(spark, SF).collect() if r.n_chars == len(r.text)}
    assert got == want


def test_tables_of_any_shape(spark):
    rows = [(1, "u", "<p>a</p>", "x"), (1, "u", "<p>a</p>", "x"), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").withColumn("main_text", F.lit(7))
    got = html_text.extract(pages)
    assert sorted(map(repr, ((r.page_id, r.text, r.main_text) for r in got.collect()))) == sorted(map(repr, [(1, "a", 7), (1, "a", 7), (None, "", 7)]))
    assert html_text.extract(pages.limit(0)).collect() == []
