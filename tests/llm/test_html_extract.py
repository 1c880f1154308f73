import time

import pytest

from loam.llm import html_extract as H, queries

LONG = "This is a paragraph of the article, with commas, clauses, and enough words to count as one."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News, sport</a></li></ul></nav>
<div class="sidebar">Side, bar, text, with, many, commas</div><div id="cookie-notice">We use cookies, and more.</div>
<div class="content"><h2>Head &amp; line</h2><p>{LONG}</p><p>Second&nbsp;one:
   <b>bold</b> and <a href="#">link</a>, fine.<p>Unclosed {LONG}<ul><li>item one<li>item two</ul>
<form><input value="x"><label>Name</label></form><div class="ad">Buy, buy, buy, now</div></div>
<section id="comments"><p>{LONG} says a reader.</p></section><footer>&copy; us</footer></body></html>"""


def test_article_without_the_rest():
    assert H.main_text(PAGE).split("\n") == ["Head & line", LONG, "Second one: bold and link, fine.", "Unclosed " + LONG, "item one", "item two"]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""), ("<p>", ""), ("just text", "just text"), ("<p>a<p>b", "a\nb"), ("<div>one<br>two</div>", "one two"), ("<b>x</i>y", "xy"), ("a < b &lt; c", "a < b < c"),
        ("<article><h1>T</h1><p>UND.</p></article><footer>x</footer>", "T\nUND."), ("<!-- <p>no</p> --><p>yes</p>", "yes"), ("<!-- never closed <p>no</p>", ""), ("<script>var a = '<p>no</p>'", ""),
        ("<table><tr><td>a<td>b</table>", "a\nb"), ("<p hidden>no</p><p>yes</p>", "yes"), ("<a title='a>b'>t</a>", "t"),
    ],
)
def test_small_pages(page, text):
    assert H.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<p>see <a href="/hidden-gems">these</a> now</p>', "see these now"), ('<div style="overflow:hidden"><p>kept</p></div>', "kept"), ("<p title='hidden menu'>kept</p>", "kept"),
        ('<p><a href="/p?id=search">found</a> it</p>', "found it"), ("<p data-id=nav>kept</p>", "kept"), ('<p HIDDEN>no</p><p ID = "nav">no</p><p aria-hidden=true>no</p><p>yes</p>', "yes"),
        ('<p>a <svg width="1"/> b</p>', "a b"), ("<p>a <math/> b</p>", "a b"), ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math> holds</p>", "so x=2 holds"), ("<p>a <svg><text>no</text></svg> b</p>", "a b"),
    ],
)
def test_names_of_attributes_and_foreign_elements(page, text):
    assert H.main_text(page) == text


def test_long_and_deep_pages_are_linear():
    assert H.main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert H.main_text("<p>" + "word " * 200_000 + "</p>").count("word") == 200_000
    H.main_text('<a "' * 50_000)


@pytest.mark.parametrize(
    "page",
    [
        "<div>x" * 50_000, "<b>" * 50_000 + "</i>" * 50_000, '<a href="' * 50_000, "<h1>x" * 50_000, "<b>" * 50_000 + "<p>x</p>" * 50_000, "<li>x<b>" * 50_000, "<" + "a" * 200_000 + ' "<x>', "<script " * 50_000,
        "<i><div>" + "<b>" * 50_000 + "</i>" * 50_000, "<table><tr><td>" * 20_000 + "x", "<p>x<b>" * 50_000,
    ],
)
def test_deep_pages_take_seconds(page):
    began = time.perf_counter()
    H.main_text(page)
    assert time.perf_counter() - began < 20


def test_what_is_cut_off_in_a_tag_goes():
    assert H.main_text('<p>kept text</p><p class="x') == "kept text" and H.main_text("<p>a < b") == "a < b" and H.main_text("<p>x <!-- y") == "x"


def test_whole_table(spark, sf_dir):
    import re
    from html import unescape

    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = queries.op4_html_text(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"(?s)<article>(.*)</article>", pages[r.page_id].html)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]+>", " " if x else "", b)).split()) for x, b in enumerate(re.split(r"</?(?:p|h1)>", article))]
        assert r.text.split() == "\n".join(blocks).split() and r.n_chars == len(r.text)


def test_nulls_and_clashing_columns(spark):
    rows = H.extract(spark.createDataFrame([(1, None, "x"), (2, "<p>t</p>", "y")], "page_id int, html string, text string")).orderBy("page_id").collect()
    assert [(r.text, r.n_chars) for r in rows] == [("", 0), ("t", 1)]
