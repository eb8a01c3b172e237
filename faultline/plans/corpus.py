"""Registered queries: token cleaning, records, comments and pages
(entries A and B of the original pipeline) over the driver tables.

Stand-ins: ``documents`` for commit text, ``conversations`` for ordered
comments of one record, ``pages`` for landed web pages, ``events`` for the
commit listing and the embedded JSON column.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.functions import html as H
from faultline.functions import urls as U
from faultline.functions.text import ISSUE_TITLE_PREFIX, LEMMA_EXCEPTIONS, clean_tokens, is_fix_title
from faultline.operators import records as R
from faultline.operators.lemmas import lemma_table, with_lemmas
from faultline.operators.links import two_hop
from faultline.session import written
from faultline.sources.tables import pinned, spread, table

# Wanted and excluded title words for the fix filter on the stand-in corpus.
TITLE_WANTED = ["license"]
TITLE_EXCLUDED = ["public"]
# Occurrences that make a token a word of the stand-in lexicon.
LEXICON_COUNT = 3
# Bot phrase pairs (both phrases of a pair in the first paragraph -> bot).
BOT_PHRASE_PAIRS = [("the", "and"), ("de", "la")]
# Listing window and per-user cap.
WINDOW_SINCE = "2024-01-05 00:00:00"
WINDOW_UNTIL = "2024-01-20 23:59:59"
LISTING_CAP = 10
# Page rules: title separator, kept link hosts and the page validity rule.
TITLE_SEPARATOR = "."
PAGE_LINK_HOSTS = [".example."]
PAGE_URL_PATTERN = r"^https?://([^/]+)/([a-z]{2})/([0-9]+)"
MIN_PARAGRAPHS = 1
MIN_LINKS = 6


def clean_tokens_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1-T8 over whole documents."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    toks = docs.select("doc_id", clean_tokens("text").alias("toks"))
    return toks.select("doc_id", F.array_join("toks", " ").alias("tokens"),
                       F.size("toks").alias("n_tokens"))


def token_counts(spark, sf_dir):
    """T8 + count per token over the whole corpus (partial aggregation first)."""
    docs = spread(table(spark, sf_dir, "documents").select("text"))
    return (docs.select(F.explode(clean_tokens("text")).alias("token"))
                .groupBy("token").agg(F.count(F.lit(1)).alias("n")))


def _lexicon(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents' tokens, vocabulary with counts, lemma table): the lexicon is what the
    corpus itself uses ``LEXICON_COUNT`` times or more."""
    docs = written(spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", clean_tokens("text", lemmas=False).alias("toks")))
    vocabulary = docs.select(F.explode("toks").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    lexicon = vocabulary.where(F.col("n") >= LEXICON_COUNT).select(F.col("token").alias("word"))
    irregular = spark.createDataFrame(list(LEMMA_EXCEPTIONS.items()), "form string, lemma string")
    return docs, vocabulary, lemma_table(vocabulary, lexicon, irregular)


def lexicon_lemmas(spark, sf_dir):
    """Each distinct token of the corpus, its lemma by the lexicon, and its count."""
    _, vocabulary, lemmas = _lexicon(spark, sf_dir)
    return vocabulary.join(lemmas, "token").select("token", "lemma", "n")


def lexicon_tokens(spark, sf_dir):
    """Whole documents cleaned, their tokens replaced by the lexicon's lemmas."""
    docs, _, lemmas = _lexicon(spark, sf_dir)
    out = with_lemmas(docs, "doc_id", "toks", written(lemmas))
    return out.select("doc_id", F.coalesce(F.array_join("toks", " "), F.lit("")).alias("tokens"))


def fix_title_filter(spark, sf_dir):
    """Every line of a document is a listing title; a title is kept
    when its cleaned lemmas hold a wanted word and no excluded one."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "title"))
    return lines.where(is_fix_title(clean_tokens("title"), TITLE_WANTED, TITLE_EXCLUDED))


def _turn_segments(spark, sf_dir):
    conv = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    toks = clean_tokens("text")
    seg = (F.when(F.col("role") == "system", R.segment(toks, False))
            .when(F.col("role") == "user", R.segment(toks, True, ISSUE_TITLE_PREFIX))
            .otherwise(R.segment(toks, True)))
    return conv.select("conv_id", "turn", pinned(seg).alias("seg"))


def conversation_text(spark, sf_dir):
    """One text per conversation, segments in turn order.
    System turns skip empty bags; user turns are prefixed like issue titles
    and, like comments, keep empty bags."""
    return R.join_segments(_turn_segments(spark, sf_dir), "conv_id", "turn", "seg", "text")


def conversation_size(spark, sf_dir):
    """Sizes per conversation."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "role")
    return conv.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.count_if(F.col("role") != "system").alias("total_discussions"),
        F.count_if(F.col("role") == "user").alias("n_user"),
        F.count_if(F.col("role") == "assistant").alias("n_assistant"))


def nested_record(spark, sf_dir):
    """P13 P15 (+P12, K1 rule): one nested record per conversation, as JSON.
    Each turn is a discussion holding one comment; only the first comment
    (the first turn after sorting inside the record) carries ``type`` and
    ``author``. One shuffle: the grouping itself."""
    conv = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    parts = conv.select("conv_id", F.struct(F.col("turn").alias("o"), F.col("role").alias("role"),
                                            clean_tokens("text").alias("content")).alias("p"))
    rec = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("_p"))
    ds = F.transform("_p", lambda x, i: F.struct(
        (x["o"] + 1).cast("int").alias("discussion_number"),
        F.array(F.struct(F.when(i == 0, F.lit("description")).alias("type"),
                         x["content"].alias("content"),
                         F.when(i == 0, x["role"]).alias("author"))).alias("comments")))
    record = F.struct(F.size("_p").cast("int").alias("total_discussions"),
                      R.empty_to_null(ds).alias("discussions"))
    return rec.select("conv_id", F.to_json(record, {"ignoreNullFields": "false"}).alias("record_json"))


def bot_filter(spark, sf_dir):
    """Bot comments (by the first paragraph) dropped, the rest
    numbered from 2 in turn order; turn 0 is the description (number 1)."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    para = F.substring_index(F.col("text"), "\n", 1)
    desc = conv.where(F.col("turn") == 0).select("conv_id", "turn", F.lit(1).alias("discussion_number"))
    rest = R.number_surviving(conv.where(F.col("turn") > 0), "conv_id", "turn",
                              ~R.bot_mask(para, BOT_PHRASE_PAIRS))
    return desc.unionByName(rest.select("conv_id", "turn", F.col("discussion_number").cast("int")))


def role_filter(spark, sf_dir):
    """comment turns (not system, not the opening turn) with a
    non-empty body whose author differs from the opening turn's author."""
    conv = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    opener = conv.where(F.col("turn") == 0).select("conv_id", F.col("role").alias("issue_author"))
    comments = conv.where((F.col("turn") > 0) & ~F.col("role").eqNullSafe(F.lit("system"))
                          & (F.trim(F.col("text")) != "")) \
                   .select("conv_id", "turn", F.col("role").alias("author"))
    return R.other_author_comments(comments, "conv_id", "author", opener) \
            .select("conv_id", "turn", "author")


def before_after_pairs(spark, sf_dir):
    """Each changed item (turn >= 1) with the content before (turn-1)
    and after (turn): the row has the one, a left join the other."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    items = conv.where(F.col("turn") >= 1).withColumnRenamed("text", "after")
    before = conv.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    return items.join(before, ["conv_id", "turn"], "left").select("conv_id", "turn", "before", "after")


def event_props_json(spark, sf_dir):
    """Typed field out of an embedded JSON string; bad JSON -> NULL."""
    ev = table(spark, sf_dir, "events").select("event_id", "props")
    parsed = F.from_json("props", "k INT")
    return ev.select("event_id", parsed["k"].alias("k"))


def event_props_keys(spark, sf_dir):
    """Every key of an embedded JSON object with its type and value, whatever
    keys it has; bad JSON and other values give none."""
    ev = table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("v"))
    found = ev.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    return found.select("event_id", "key", F.schema_of_variant("value").alias("type"), F.try_variant_get("value", "$", "string").alias("value"))


def time_window_limit(spark, sf_dir, since: str = WINDOW_SINCE, until: str = WINDOW_UNTIL,
                      cap: int = LISTING_CAP):
    """Events inside [since, until], newest first, first ``cap`` per
    user. ``row_number() <= cap`` lets Spark apply the group limit before the
    shuffle, so a hot user ships at most ``cap`` rows per map task."""
    if datetime.fromisoformat(str(since)) > datetime.fromisoformat(str(until)):
        raise ValueError("invalid window: since is after until")
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    ev = ev.where(F.col("ts").between(F.lit(since).cast("timestamp_ntz"), F.lit(until).cast("timestamp_ntz")))
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").asc())
    return ev.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap)


def _page_links(spark, sf_dir):
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    links = F.transform(U.hrefs("html"), lambda h: U.resolve(h, F.col("url")))
    keep = F.filter(links, lambda u: U.is_wanted_link(u, F.col("url"), hosts=PAGE_LINK_HOSTS,
                                                      require_kind=False))
    return pages.select("page_id", "url", F.array_sort(F.array_distinct(keep)).alias("links"))


def page_links(spark, sf_dir):
    """Wanted links of each page, sorted and distinct."""
    p = _page_links(spark, sf_dir)
    return p.select("page_id", F.size("links").alias("n_links"), F.array_join("links", " ").alias("links"))


def page_title(spark, sf_dir):
    """Title part before the first separator, '' when absent."""
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html"))
    return pages.select("page_id", H.title_before("html", TITLE_SEPARATOR).alias("title"))


def page_main_text(spark, sf_dir):
    """First ad block, heading, article paragraphs and nav
    labels of each page, from one run of the automaton."""
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html"))
    tag = H.start_tag
    found = H.all_texts("html", ("article",), ad=tag("div", "ad"), article=tag("article"), heading=tag("h1"), p=tag("p"), a=tag("a"))
    x = pages.select("page_id", pinned(found).alias("x"))
    first = lambda name: F.when(F.col(f"x.{name}").isNotNull(), F.coalesce(F.get(F.col(f"x.{name}"), 0)["text"], F.lit("")))
    article = F.get("x.article", 0)
    paras = F.transform(F.filter("x.p", lambda p: (p["first"] > article["first"]) & (p["last"] <= article["last"]) & (p["text"] != "")), lambda p: p["text"])
    return x.select(
        "page_id", first("ad").alias("ad_text"), first("heading").alias("heading"),
        F.array_join(paras, "\n").alias("body"), F.size(paras).alias("n_paragraphs"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("x.a", lambda a: a["text"]))), "|").alias("nav_labels"))


def page_quarantine(spark, sf_dir):
    """K9: pages whose extraction failed (too few paragraphs or links), with
    the reason and the raw size; valid pages are the complement."""
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    n_par = F.size(H.paragraphs(H.element_html("html", "article")))
    n_links = F.size(F.array_distinct(U.hrefs("html")))
    x = pages.select("page_id", "url", pinned(n_par).alias("n_paragraphs"), pinned(n_links).alias("n_links"),
                     F.length("html").alias("html_chars"))
    reason = (F.when(F.col("n_paragraphs") < MIN_PARAGRAPHS, F.lit("no_paragraphs"))
               .when(F.col("n_links") < MIN_LINKS, F.lit("few_links")))
    return x.withColumn("reason", reason).where(F.col("reason").isNotNull())


def page_block_text(spark, sf_dir):
    """P7 (nested tags): text of the first ``div.ad`` block of a page that wraps the whole
    given page: nested blocks, a table, an end tag in a comment, in a script and in a
    quoted attribute, a void element, a paragraph that is never closed and numeric references stand around it."""
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html"))
    view = F.concat(F.lit('<!-- <div class="ad">old</div> --><div class="x">no</div><div id="a" title="</div> a>b" class="big ad"><div><!-- </div> --><b>page</b> '
                          '<script>if (a < b) s = "</div></div>";</script><p>first<div>'), F.col("html"),
                    F.lit("</div></div><table><tr><td><div>second</div><td>third<br></table><div/>&#8217;</div-x> <div>end</div></div>"
                          "<div class=\"ad\">after</div>"))
    return pages.select("page_id", view.alias("view")).select("page_id", H.element_text("view", "div", "ad").alias("block_text"))


def two_hop_links(spark, sf_dir):
    """Links of each page plus the links of the pages they point to
    (pages are keyed by URL, so each hop is a many-to-one join)."""
    p = _page_links(spark, sf_dir)
    edges = p.select(F.col("url").alias("src"), F.explode("links").alias("dst"))
    nodes = p.select("page_id", "url")
    return two_hop(edges, nodes)


def url_parts(spark, sf_dir):
    """owner/repo-style path parts and pattern groups of page URLs."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    owner, repo = U.repo_parts("url")
    host, lang, num = U.url_groups("url", PAGE_URL_PATTERN, 3)
    return pages.select("page_id", owner.alias("owner"), repo.alias("repo"),
                        host.alias("host"), lang.alias("lang"), num.alias("num"))
