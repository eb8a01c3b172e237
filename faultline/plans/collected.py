"""Registered queries of the collection flow (J6 both hops, P7-P11 by page kind,
P13, P15, K9, F3), on a landed-pages view made of ``conversations`` with all its texts.

Conversation c is a commit page that links to a pull-request page and an issue
page; the pull-request page links to another issue page and a security page. Its
first turn is the description of the commit, the pull request and the security page
and the body of the issue, each later one a discussion table whose comment cell holds
the turn's text, an inner table and a second paragraph. Comments, scripts and quoted
attributes with end tags stand between. Some pages of each kind are made to fail.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import pages as PG
from faultline.operators import records as R
from faultline.sources.tables import table


#: Bytes of texts to a task: extraction takes seconds for each MB, so tasks of the size
#: that suits a shuffle would take as long as the input is large. And the most tasks.
TASK_BYTES, MOST_TASKS = 4 << 20, 50_000


def task_count(texts: DataFrame) -> int:
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(max(texts.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)), MOST_TASKS)


def _html(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def landed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(commit_url, html) of commit pages and (url, html) of the linked pages."""
    escaped = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", escaped.alias("text")))), lambda x: x["text"])
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    # The grouping stays in this partitioning; a given number is not coalesced.
    conv = rows.repartition(task_count(rows), "conv_id").groupBy("conv_id").agg(turns.alias("turns"))
    c = F.col("conv_id")
    text = c.cast("string")
    conv = conv.select("conv_id", F.get("turns", 0).alias("first"), F.slice("turns", 2, F.size("turns")).alias("turns"),
                       _html("https://github.com/acme/repo", (c % 7).cast("string")).alias("base"))
    base, first = F.col("base"), F.col("first")
    commit, pull = _html(base, "/commit/", F.substring(F.md5(text), 1, 12)), _html(base, "/pull/", text)
    issue, more = _html(base, "/issues/", (2 * c).cast("string")), _html(base, "/issues/", (2 * c + 1).cast("string"))
    advisory = _html(base, "/security/advisories/GHSA-", text)
    script = f"<script {PG.EMBEDDED_DATA_ATTR}>"
    files = F.array_join(F.transform(F.sequence(F.lit(0), (c % 4).cast("int")), lambda i: _html('{"path":"f', i.cast("string"), '.ts"}')), ",")
    odd = '<!-- </div></td> <p dir="auto"> --><script>var s = "</div></td>";</script><br title="</div> > ">'
    good_commit = _html("<title>Fix crash ", text, " · acme</title>", f'<span class="x {PG.COMMIT_DESCRIPTION_CLASS} y">', odd, first, "</span>",
                        script, '{"payload":{"diffEntryData":[', files, "]}}</script>",
                        script, '{"payload":{"commit":{"parents":["p', text, '"]}}}</script>')
    tables = F.array_join(F.transform("turns", lambda t, i: _html(
        f'<table class="{PG.PR_TABLE_CLASS}" {PG.PR_TABLE_ATTR}="true"><tr><td class="{PG.PR_COMMENT_CELL_CLASS}">', odd, '<p dir="auto">', t,
        "<table><tr><td>inner</td></tr></table><p dir=\"auto\">tail ", (i + 1).cast("string"), "</td></tr></table>")), "")
    good_pull = _html('<h1 class="gh-header-title">T</h1><div class="comment-body"><div>nested</div>', odd, "<div>", first, "</div></div>", tables)
    label = lambda x: _html(f'<span class="{PG.ISSUE_LABEL_CLASS_PATTERN}-x"><i></i><span class="{PG.ISSUE_LABEL_TEXT_CLASS}">', x, "</span></span>")
    good_issue = _html(label(F.lit("bug")), label(_html("kind ", (c % 3).cast("string"))), f'<div data-testid="{PG.ISSUE_BODY_TESTID}"><div>deep</div>', odd, first, "</div>")
    a = lambda u: _html('<a href="', u, '">x</a>')
    commits = conv.select(commit.alias("commit_url"), _html(F.when(c % 11 == 0, "<title>none</title>").otherwise(good_commit), a(pull), a(issue), a(commit)).alias("html"))
    page = lambda u, h: F.struct(u.alias("url"), h.alias("html"))
    pages = conv.select(F.explode(F.array(
        page(pull, _html(F.when(c % 13 == 0, "").otherwise(good_pull), a(more), a(advisory), a(pull))),
        page(issue, good_issue), page(more, F.when(c % 5 == 0, f"{script}{{bad</script>").otherwise(good_issue)),
        page(advisory, _html(f'<h1 class="{PG.SECURITY_TITLE_CLASS}">Advisory</h1><div class="{PG.SECURITY_BODY_CLASS}">', odd, first, "</div>")))).alias("p")).select("p.*")
    return commits, pages


def collected_links(spark, sf_dir):
    """The landed pages that each commit page leads to, with the hop."""
    return R.linked_parts(*landed(spark, sf_dir)).select("commit_url", "url", "kind", "hop", "valid")


def collected_records(spark, sf_dir):
    """What each nested record holds."""
    rec = R.assemble_records(*landed(spark, sf_dir))
    pull, issues = F.get("pull_requests", 0), F.col("issues")
    return rec.select(
        "commit_url", F.col("commit").isNotNull().alias("has_commit"), F.array_join("commit.changed_files", ",").alias("files"),
        F.array_join("commit.description", " ").alias("description"),
        F.col("commit.parent").alias("parent"), F.size("pull_requests").alias("n_pulls"), pull["total_discussions"].alias("n_discussions"),
        F.array_join(F.transform(pull["discussions"], lambda d: F.array_join(F.get(d["comments"], 0)["content"], " ")), "|").alias("discussions"),
        F.size("issues").alias("n_issues"), F.array_join(F.get(issues, 0)["labels"], ",").alias("labels"),
        F.array_join(F.get(F.get(issues, 0)["comments"], 0)["content"], " ").alias("issue_text"), F.size("security").alias("n_security"),
        F.array_join(F.get("security", 0)["content"], " ").alias("security_text"))


def page_quarantine_kinds(spark, sf_dir):
    """K9: failed pages by kind, with the size of the kept html."""
    return R.failed_pages(*landed(spark, sf_dir)).select("url", "kind", (F.length("html") > 0).alias("has_html"))


def page_kind_counts(spark, sf_dir):
    """K9: of each kind the pages that one pass has landed, kept and put aside, and
    the counts of the whole pass."""
    parts, seen = R.extract_pages(*landed(spark, sf_dir))
    return parts.groupBy("kind").agg(F.count("*").alias("n_pages"), F.count_if("valid").alias("n_good"), F.count_if(~F.col("valid")).alias("n_failed")) \
                .select("*", *[F.lit(seen[k]).cast("long").alias(f"all_{k}") for k in ("pages", "good", "failed")])


_VIEW = """
WITH v AS (SELECT conv_id AS c, list(coalesce(text, '') ORDER BY turn, text NULLS FIRST) AS turns, 'https://github.com/acme/repo' || (conv_id % 7) AS base
           FROM conversations GROUP BY conv_id),
u AS (SELECT *, base || '/commit/' || substr(md5(CAST(c AS VARCHAR)), 1, 12) AS commit_url, base || '/pull/' || c AS pull,
             base || '/issues/' || (2 * c) AS issue, base || '/issues/' || (2 * c + 1) AS more, base || '/security/advisories/GHSA-' || c AS adv FROM v)
"""


def oracles() -> dict[str, str]:
    from faultline.plans.oracles import _clean_sql
    words = lambda text: f"array_to_string({_clean_sql(text)}, ' ')"
    return {
        "page_kind_counts": _VIEW + """,
p AS (SELECT 'commit' AS kind, c % 11 <> 0 AS ok FROM u UNION ALL SELECT 'pull', c % 13 <> 0 FROM u UNION ALL SELECT 'issue', TRUE FROM u
      UNION ALL SELECT 'issue', c % 5 <> 0 FROM u UNION ALL SELECT 'security', TRUE FROM u)
SELECT kind, count(*) AS n_pages, count(*) FILTER (WHERE ok) AS n_good, count(*) FILTER (WHERE NOT ok) AS n_failed,
       (SELECT count(*) FROM p) AS all_pages, (SELECT count(*) FROM p WHERE ok) AS all_good, (SELECT count(*) FROM p WHERE NOT ok) AS all_failed
FROM p GROUP BY kind""",
        "collected_links": _VIEW + """
SELECT commit_url, pull AS url, 'pull' AS kind, 1 AS hop, c % 13 <> 0 AS valid FROM u
UNION ALL SELECT commit_url, issue, 'issue', 1, TRUE FROM u UNION ALL SELECT commit_url, more, 'issue', 2, c % 5 <> 0 FROM u
UNION ALL SELECT commit_url, adv, 'security', 2, TRUE FROM u""",
        "page_quarantine_kinds": _VIEW + """
SELECT commit_url AS url, 'commit' AS kind, TRUE AS has_html FROM u WHERE c % 11 = 0
UNION ALL SELECT pull, 'pull', TRUE FROM u WHERE c % 13 = 0 UNION ALL SELECT more, 'issue', TRUE FROM u WHERE c % 5 = 0""",
        "collected_records": _VIEW + f"""
SELECT commit_url, c % 11 <> 0 AS has_commit,
  CASE WHEN c % 11 <> 0 THEN array_to_string(list_transform(range(0, c % 4 + 1), lambda i: 'f' || i || '.ts'), ',') END AS files,
  CASE WHEN c % 11 <> 0 THEN {words('turns[1]')} END AS description,
  CASE WHEN c % 11 <> 0 THEN 'p' || c END AS parent, CASE WHEN c % 13 <> 0 THEN 1 END AS n_pulls,
  CASE WHEN c % 13 <> 0 THEN CAST(len(turns) AS INT) END AS n_discussions,
  CASE WHEN c % 13 <> 0 THEN array_to_string(list_transform(turns, lambda x, i: {words("CASE WHEN i = 1 THEN 'nested ' || x ELSE x || ' tail ' || (i - 1) END")}), '|') END AS discussions,
  CAST(CASE WHEN c % 5 <> 0 THEN 2 ELSE 1 END AS INT) AS n_issues, 'bug,kind ' || (c % 3) AS labels,
  {words("'deep ' || turns[1]")} AS issue_text, 1 AS n_security, {words('turns[1]')} AS security_text
FROM u""",
    }
