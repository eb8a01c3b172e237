from pyspark.sql import functions as F

from faultline.functions import html as H
from faultline.functions import labels as L
from faultline.functions import urls as U


def test_recode(spark):
    df = spark.createDataFrame([(" Missing Cases ",), ("Runtime exception",), ("",), (None,)], "x string")
    out = [r.y for r in df.select(L.recode_label("x").alias("y")).collect()]
    assert out == ["Missing Case", "Runtime exception", "", None]


def test_normalize_and_numbers(spark):
    df = spark.createDataFrame([("fabric.js", "1,234"), (" LlamaIndexTS ", "n/a"), ("vue-i18n", None)],
                               "n string, v string")
    rows = df.select(L.normalize_key("n").alias("k"), L.parse_grouped_number("v").alias("v")).collect()
    assert [(r.k, r.v) for r in rows] == [("fabricjs", 1234.0), ("llamaindexts", None), ("vue-i18n", None)]


def test_half_even(spark):
    df = spark.createDataFrame([(1.125,), (2.5,)], "x double")
    assert [r.y for r in df.select(L.round_half_even("x", 2).alias("y")).collect()] == [1.12, 2.5]


def test_repo_parts(spark):
    df = spark.createDataFrame([("https://github.com/a/b/",), (" https://github.com/a/b/tree/x ",),
                                ("https://github.com/onlyone",)], "u string")
    o, r = U.repo_parts("u")
    assert [(x.o, x.r) for x in df.select(o.alias("o"), r.alias("r")).collect()] == \
        [("a", "b"), ("a", "b"), (None, None)]


def test_commit_url_groups(spark):
    df = spark.createDataFrame([("https://github.com/o/r/commit/abc1234def",), ("https://github.com/o/r/commit/abc12",)],
                               "u string")
    cols = U.url_groups("u")
    rows = df.select(*[c.alias(f"g{i}") for i, c in enumerate(cols)]).collect()
    assert tuple(rows[0]) == ("o", "r", "abc1234")
    assert tuple(rows[1]) == (None, None, None)


def test_link_predicate(spark):
    urls = ["https://github.com/o/r/issues/1", "https://github.com/o/r/tree/HEAD/x/issues/1",
            "https://github.com/security/advanced-security", "https://github.com/o/r/security/advisories/1",
            "https://github.com/o/r/pull/2", "https://example.com/o/r/issues/3",
            "https://github.com/o/r/commit/abc/issues/4"]
    df = spark.createDataFrame([(u, "https://github.com/o/r/commit/abc") for u in urls], "u string, b string")
    keep = [r.k for r in df.select(U.is_wanted_link("u", "b").alias("k")).collect()]
    assert keep == [True, False, False, True, True, False, False]
    only_issue = [r.k for r in df.select(U.is_wanted_link("u", "b", kinds=U.ISSUE_ONLY_KINDS).alias("k")).collect()]
    assert only_issue[4] is False


def test_html_helpers(spark):
    html = ('<html><head><title>Fix crash · Pull Request #1 · o/r</title></head><body>'
            '<div class="x ad">A &amp; B</div><article><h1>T</h1><p>one <b>two</b><p></p><p>three</p>'
            '</article><a href="/x">L1</a><a href="/y">L0</a></body></html>')
    df = spark.createDataFrame([(html,)], "h string")
    r = df.select(H.title_before("h").alias("t"), H.element_text("h", "div", "ad").alias("ad"),
                  H.comment_text(H.element_html("h", "article")).alias("c"),
                  H.tag_texts("h", "a").alias("n"), U.hrefs("h").alias("l")).first()
    assert r.t == "Fix crash"
    assert r.ad == "A & B"
    assert r.c == "one two\nthree"
    assert r.n == ["L0", "L1"]
    assert r.l == ["/x", "/y"]


def test_nested_elements_and_numeric_references(spark):
    html = '<div class="c"><div>in <b>x</b></div> tail &#8217;&#x27;&#xD800;&#65;</div><div class="c">second</div>'
    df = spark.createDataFrame([(html,), ("<div>never <div>closed</div> at all",), ("<divider>no</divider>",), (None,)], "h string")
    rows = df.select(H.element_text("h", "div", "c").alias("c"), H.element_text("h", "div").alias("d")).collect()
    assert rows[0].c == "in x tail \u2019'\ufffdA"
    assert rows[1].d == "never closed at all"
    assert rows[2].d == "" and rows[3].d is None
