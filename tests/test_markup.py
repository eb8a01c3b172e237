"""The token automaton of ``functions/html.py`` on markup as it is found."""

import random

import pytest
from pyspark.sql import functions as F

from faultline.functions import html as H


def run(spark, html, column):
    return spark.createDataFrame([(html,)], "h string").select(column.alias("x")).first().x


CASES = [
    # comments, raw text, quoted attributes, void elements
    ('<div class="c">a<!-- </div> -->b</div>c', "a b"),
    ('<!-- <div class="c">no</div> --><div class="c">yes</div>', "yes"),
    ('<div class="c">a<script>var s = "</div>"; if (x < y) t("<p>");</script>b</div>c', "a b"),
    ('<div class="c">a<style>p > a {}</style>b</div>c', "a b"),
    ('<div a="x>y" class="c">in</div>out', "in"),
    ("<div a='</div>' class='c'>in</div>out", "in"),
    ("<div class=c>in</div>out", "in"),
    ('<div data-x=\'class="c"\'>no</div><div CLASS="b c d">yes</DIV>', "yes"),
    ('<div class="c">a<br>b<img src="x>y">d<hr>e</div>f', "a b d e"),
    # elements that are not closed, or closed by others
    ('<div class="c"><p>one<p>two<b>three</div>four', "one two three"),
    ('<div><div class="c">one<span>two</div>three</div>', "one two"),
    ('<div class="c">one</span></b>two</div>three', "one two"),
    ('<section><div class="c">one<div>two</section>three', "one two"),
    ('<div class="c">never <div>closed', "never closed"),
    ('<div class="c"><div/>one</div>two', "one"),
    # text that looks like markup
    ('<div class="c">1 < 2 && 3 > 2</div>x', "1 < 2 && 3 > 2"),
    ('<div class="c">a <3 b</div>x', "a <3 b"),
    ('<div class="c">a &lt;/div&gt; b</div>x', "a </div> b"),
    ('<div class="c">a<!-- never closed </div>', "a"),
    ('<div class="c">x<textarea><div></textarea>y</div>z', "x <div> y"),
    ('<div title="open class="c">odd</div>', ""),
    ('<?xml version="1"?><!DOCTYPE html><div class="c">z</div>', "z"),
    ("", ""), (None, None), ("<", ""), ("</", ""), ("<div", ""), ('<div class="c"', ""),
]


@pytest.mark.parametrize("html,text", CASES)
def test_element_text(spark, html, text):
    assert run(spark, html, H.element_text("h", "div", "c")) == text


def test_paragraphs_end_at_blocks(spark):
    html = "<p>a<p dir=x>b <i>c</i></p>no<p>d<ul><li>e<p>f<li>g</ul><p><table><tr><td><p>h<td>i<tr><td>j</table>k<p>  </p>"
    assert run(spark, html, H.paragraphs("h")) == ["a", "b c", "d", "f", "h"]
    assert run(spark, html, H.element_texts("h", H.start_tag("li"))) == ["e f", "g"]
    assert run(spark, html, H.element_texts("h", H.start_tag("td"))) == ["h", "i", "j"]


def test_nested_elements_come_by_their_start(spark):
    html = '<div id="1"><div id="2">a</div><div>b<div id="3">c</div></div></div><div id=4>d</div>'
    assert run(spark, html, H.all_elements("h", H.start_tag("div", id=True))) == [
        '<div id="2">a</div><div>b<div id="3">c</div></div>', "a", "c", "d"]


def test_attributes(spark):
    tag = "<a data-href=\"no\" href = 'x y' title=\"a &amp; b > c\" hidden class=one/>"
    for key, value in (("href", "x y"), ("title", "a & b > c"), ("class", "one/"), ("hidden", ""), ("ref", "")):
        assert run(spark, tag, H.attribute("h", key)) == value
    assert run(spark, tag, F.array(*[H.has_attribute("h", k) for k in ("hidden", "href", "ref", "title")])) == [True, True, False, True]


def test_tokens_are_the_page_again(spark):
    rng = random.Random(5)
    bits = ["<", ">", "</", "/>", "<!--", "-->", "div", "p", " ", '"', "'", "=", "a", "<script>", "</script>", "<br>", "é", "\n", "&lt;", "<div class=\"c\">", "</div>"]
    pages = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 60)))) for i in range(400)]
    df = spark.createDataFrame(pages, "i int, h string")
    rows = df.select("h", F.array_join(H.tokens("h"), "").alias("again"), H.element_text("h", "div", "c").alias("t")).collect()
    assert all(r.h == r.again and r.t is not None for r in rows)


def test_long_and_deep_pages(spark):
    deep = "<div class='c'>" + "<b>" * 3000 + "x" + "<i a='1' b=2>" * 500 + "</div>tail"
    assert run(spark, deep, H.element_text("h", "div", "c")) == "x"
    wide = "<div class='c'" + " a='>'" * 20000 + ">" + "<p>w" * 2000 + "</div>"
    assert run(spark, wide, F.length(H.element_text("h", "div", "c"))) == 2000 * 2 - 1


def test_lines_and_scripts(spark):
    html = '<div>  one <b>two</b>\n<br> three </div><script type=x data-t="d">{"a":"</b>"}</script><!--<script data-t="d">no</script>-->'
    assert run(spark, html, H.lines("h")) == "one\ntwo\nthree"
    assert run(spark, html, H.scripts("h", H.start_tag("script", data_t="d"))) == ['{"a":"</b>"}']


def test_title(spark):
    assert run(spark, '<svg></svg><title lang="en">A <b> &amp; B · C</title>', H.title_before("h")) == "A <b> & B"


def test_many_elements_in_one_run(spark):
    html = '<p>0<div class="ad">x<p>1</div><article><h1>H</h1><p>2<p class="ad">3</article><p>4'
    x = run(spark, html, H.all_texts("h", ("article",), ad=H.start_tag("div", "ad"), article=H.start_tag("article"), p=H.start_tag("p")))
    assert [r.text for r in x.ad] == ["x 1"] and [r.text for r in x.article] == [""] and [r.text for r in x.p] == ["0", "1", "2", "3", "4"]
    inside = [r.text for r in x.p if x.article[0].first < r.first and r.last <= x.article[0].last]
    assert inside == ["2", "3"]
    assert run(spark, None, H.all_texts("h", p=H.start_tag("p"))).p is None


def test_parts_are_those_of_single_functions(spark):
    rng = random.Random(7)
    bits = ["<", "</", "<!--", "-->", '<p>', '<p dir="auto">', "</p>", '<div class="c">', "</div>", '<td class="x">', "</td>", "<table>", "</table>", "<script>",
            "</script>", "<title>", "</title>", '<table><td class="x"><p dir="auto">a', "a", " · ", "\n", "&lt;", "&#65;", '<div title="open', '"', "<br>", "<li>"]
    pages = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 80)))) for i in range(300)] + [(300, None), (301, "")]
    div, td, p = H.start_tag("div", "c"), H.start_tag("td", "x"), H.start_tag("p", dir="auto")
    parts = H.parts(
        "h", title=H.title(), text=H.first(div, H.inner(H.text_of)), code=H.script_texts(H.start_tag("script")),
        paras=H.every(H.start_tag("table"), H.inside(td, H.inner(H.paragraphs_of(p)), "CAST(array() AS array<string>)")))
    one = [H.title_before("h"), H.strip_tags(H.first_element("h", div)), H.scripts("h", H.start_tag("script")),
           H.each(H.all_elements("h", H.start_tag("table")), lambda t: H.paragraphs(H.first_element(t, td), p))]
    rows = spark.createDataFrame(pages, "i int, h string").select("h", parts.alias("x"), *[c.alias(f"c{k}") for k, c in enumerate(one)]).collect()
    for r in rows:
        assert (r.x.title, r.x.text, r.x.code, r.x.paras) == (r.c0, r.c1, r.c2, r.c3), r.h
    assert sum(bool(r.c3 and any(r.c3)) for r in rows) > 5


@pytest.mark.parametrize("n", [1, H.CHUNK // 3, H.CHUNK // 3 + 1, H.CHUNK])
def test_elements_over_the_ends_of_runs(spark, n):
    html = "<div><p>a</p>" * n + "<div class='c'>" + "<p>b</p>" * n + "</div>tail"
    assert run(spark, html, F.size(H.element_texts("h", H.start_tag("div")))) == n + 1
    assert run(spark, html, H.element_text("h", "div", "c")) == " ".join("b" * n)


def test_time_of_a_page_with_many_elements_grows_with_it(spark):
    import time
    seconds = {}
    for n in (3000, 24000):
        df = spark.createDataFrame([("<p>x</p><b>y</b>" * n,)], "h string").localCheckpoint()
        t = time.time()
        assert df.select(F.size(H.element_texts("h", H.start_tag("p"))).alias("n")).first().n == n
        seconds[n] = time.time() - t
    assert seconds[24000] < 24 * max(seconds[3000], 0.5), seconds
