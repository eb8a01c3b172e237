"""Record assembly and comment handling.

Rows are processed where they are; only the cleaned token strings travel to
the one shuffle that groups a record's parts (``collect_list`` of small
structs, sorted inside the record).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import ISSUE_TITLE_PREFIX, SEGMENT_SEPARATOR, is_bot_comment
from faultline.sources.tables import pinned


def segment(tokens: Column, keep_empty: Column | bool, prefix: str | None = None) -> Column:
    """One T10 segment from a token bag: tokens joined by a space, with an
    optional constant prefix. NULL when the segment is skipped: commit fields
    and PR titles skip empty bags, comments and issue titles keep them."""
    text = F.array_join(tokens, " ")
    if prefix:
        text = F.concat(F.lit(prefix), text)
    keep = keep_empty if isinstance(keep_empty, Column) else F.lit(keep_empty)
    return F.when(tokens.isNull(), F.lit(None)).when((F.size(tokens) > 0) | keep, text)


def join_segments(df: DataFrame, key: str, order: str, seg: str, out: str = "text",
                  sep: str = SEGMENT_SEPARATOR) -> DataFrame:
    """Ordered segments of each record joined by `` | ``. Skipped
    (NULL) segments are dropped before the shuffle; records with no segment
    do not appear (F7)."""
    parts = df.where(F.col(seg).isNotNull()).select(key, order, seg)
    return (parts.groupBy(key)
                 .agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"),
                                                           F.col(seg).alias("s")))).alias("_p"))
                 .select(key, F.array_join(F.transform("_p", lambda x: x["s"]), sep).alias(out)))


def record_segments(record: Column) -> Column:
    """T10 on a nested commit record (struct with commit, pull_requests,
    issues, security): the ordered list of segments, empties handled as in
    the original, nothing at all when ``commit`` is NULL."""
    c = record["commit"]

    def bag(x):
        return F.array_join(x, " ")

    def nonempty(x):
        return F.when(F.size(x) > 0, F.array(bag(x))).otherwise(F.array().cast("array<string>"))

    commit_part = F.concat(nonempty(c["commit_message"]), nonempty(c["description"]),
                           nonempty(c["changed_files"]))
    pr_part = F.flatten(F.transform(
        F.coalesce(record["pull_requests"], F.array()),
        lambda pr: F.concat(
            nonempty(pr["pr_title"]),
            F.flatten(F.transform(F.coalesce(pr["discussions"], F.array()),
                                  lambda d: F.transform(F.coalesce(d["comments"], F.array()),
                                                        lambda cm: bag(F.coalesce(cm["content"], F.array())))))
        )))
    issue_part = F.flatten(F.transform(
        F.coalesce(record["issues"], F.array()),
        lambda i: F.concat(
            F.when(i["title"].isNotNull(), F.array(F.concat(F.lit(ISSUE_TITLE_PREFIX), bag(i["title"]))))
             .otherwise(F.array().cast("array<string>")),
            F.transform(F.filter(F.coalesce(i["comments"], F.array()), lambda cm: cm["content"].isNotNull()),
                        lambda cm: bag(cm["content"])))))
    sec_part = F.flatten(F.transform(
        F.coalesce(record["security"], F.array()),
        lambda s: F.concat(
            F.when(s["title"].isNotNull(), F.array(bag(s["title"]))).otherwise(F.array().cast("array<string>")),
            F.when(s["content"].isNotNull(), F.array(bag(s["content"]))).otherwise(F.array().cast("array<string>")))))
    return F.when(c.isNull(), F.array().cast("array<string>")) \
            .otherwise(F.concat(commit_part, pr_part, issue_part, sec_part))


def record_text(record: Column) -> Column:
    """T10 + F7: joined text of a nested record, NULL when it has no segment."""
    segs = record_segments(record)
    return F.when(F.size(segs) > 0, F.array_join(segs, SEGMENT_SEPARATOR))


def empty_to_null(arr: Column) -> Column:
    """K1 rule: an empty list is stored as NULL."""
    return F.when(F.size(arr) > 0, arr)


def number_surviving(df: DataFrame, key: str, order: str, keep: Column, out: str = "discussion_number",
                     start: int = 2) -> DataFrame:
    """F4 + W5: drop rows failing ``keep`` and number the rest per key in
    ``order`` (unique within a key) starting at ``start`` (the description
    is number 1). Positions come from bucketed ranks of ``order``, so a key
    with a huge number of rows is not sorted in one task."""
    from faultline.operators.ranks import midranks
    kept = df.where(keep)
    ranked = midranks(kept, [key], order, out="_pos")
    return ranked.withColumn(out, (F.col("_pos") + (start - 1)).cast("int")).drop("_pos")


def bot_mask(first_paragraph: Column, phrase_pairs) -> Column:
    return is_bot_comment(first_paragraph, phrase_pairs)


def other_author_comments(comments: DataFrame, key: str, author: str, issue_author: DataFrame) -> DataFrame:
    """comments whose author (``Unknown`` when missing) differs, null
    safe, from the issue author of the same key."""
    c = comments.withColumn(author, F.coalesce(F.col(author), F.lit("Unknown")))
    return c.join(issue_author, key, "left").where(~F.col(author).eqNullSafe(F.col("issue_author")))


def page_kind(url) -> Column:
    """pull, issue or security, by the URL; NULL for others."""
    u = F.col(url) if isinstance(url, str) else url
    return F.when(u.contains("/pull/"), "pull").when(u.contains("/issues/"), "issue").when(u.contains("/security/"), "security")


def extract_pages(commit_pages: DataFrame, pages: DataFrame) -> tuple[DataFrame, dict]:
    """P6-P13 + K9: every landed page extracted once, in one pass to two outputs, and
    the counts of that pass.

    ``commit_pages`` is (commit_url, html) of the commits to collect; ``pages`` is
    (url, html) of every landed page. Rows: url, kind, valid, the part of that kind,
    the wanted links of commit and pull-request pages, and the html of pages that
    failed (a NULL html fails too). The pass is written to the shared folder by
    ``valid``, so good pages and the quarantine are read apart; the counts (pages,
    good, failed) are those of the written files. Pages of no kind are not kept."""
    from faultline.functions import pages as PG
    from faultline.functions.urls import ISSUE_ONLY_KINDS, hrefs, is_wanted_link
    from faultline.session import checkpoint_dir

    spark = pages.sparkSession
    every = commit_pages.select(F.col("commit_url").alias("url"), "html", F.lit("commit").alias("kind")).unionByName(
        pages.select("url", "html", page_kind("url").alias("kind")).where("kind IS NOT NULL"))
    kind = F.col("kind")
    wanted = F.array_distinct(F.when(kind == "commit", F.filter(hrefs("html"), lambda u: is_wanted_link(u, F.col("url")))).when(
        kind == "pull", F.filter(hrefs("html"), lambda u: is_wanted_link(u, F.col("url"), kinds=ISSUE_ONLY_KINDS) & ~u.contains("/pull/"))))
    parts = {"commit": PG.commit_page("html"), "pull": PG.pr_page("html"), "issue": PG.issue_page("html"), "security": PG.security_page("html")}
    # Pinned: the tests of validity must not repeat the extraction.
    found = every.select("url", "kind", "html", wanted.alias("links"), *[pinned(F.when(kind == k, x)).alias(k) for k, x in parts.items()])
    valid = F.when(kind == "commit", PG.commit_page_valid(F.col("commit"))).when(kind == "pull", PG.pr_page_valid(F.col("pull"))) \
             .when(kind == "issue", PG.issue_page_valid(F.col("issue"))).otherwise(F.col("html").isNotNull())
    found = found.withColumn("valid", F.coalesce(valid, F.lit(False))).withColumn("html", F.when(~F.col("valid"), F.col("html")))
    path = f"{checkpoint_dir(spark).rstrip('/')}/pages-{uuid.uuid4().hex}"
    found.write.partitionBy("valid").parquet(path)
    parts = spark.read.schema(found.schema).parquet(path)
    # From the files' footers. Not by Observation: once a session has used one, Spark 4.1
    # cannot ship functions that hold the session (Spark ML's do) to tasks any more.
    n = {r["valid"]: r["n"] for r in parts.groupBy("valid").agg(F.count("*").alias("n")).collect()}
    return parts, {"pages": sum(n.values()), "good": n.get(True, 0), "failed": n.get(False, 0)}


def page_hops(parts: DataFrame) -> DataFrame:
    """J6 + U1: (commit_url, url, hop) of the links of each commit page, and of the
    issue and security links of the pull-request pages it leads to; the smallest hop
    counts. Keys alone are joined."""
    hop1 = parts.where("kind = 'commit'").select(F.col("url").alias("commit_url"), F.explode("links").alias("url"))
    more = parts.where("kind = 'pull'").select("url", F.explode("links").alias("to"))
    hop2 = hop1.join(more, "url").select("commit_url", F.col("to").alias("url"))
    return hop1.withColumn("hop", F.lit(1)).unionByName(hop2.withColumn("hop", F.lit(2))).groupBy("commit_url", "url").agg(F.min("hop").alias("hop"))


def linked_parts(commit_pages: DataFrame, pages: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """J6 + U1: (commit_url, url, kind, hop, valid, pull, issue, security) of the
    landed pages that a commit page links to, and of the issue and security
    pages that its pull-request pages link to. ``parts``: what ``extract_pages`` made of them."""
    parts = extract_pages(commit_pages, pages)[0] if parts is None else parts
    landed = parts.where("kind != 'commit'").select("url", "kind", "valid", "pull", "issue", "security")
    return page_hops(parts).join(landed, "url")


def assemble_records(commit_pages: DataFrame, pages: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """P15 + J6 + U1 + K1 rule: nested commit records from landed pages.

    Hop 1 takes the wanted links of the commit page; pull-request pages add their
    issue and security links (hop 2). Links are joined as keys; the valid parts are
    joined to them last, by URL (many-to-one), and grouped per commit in URL order.
    A commit page whose extraction failed gives a record with a NULL commit; a
    commit without parts of a kind gets NULL for that list. The failed pages
    (K9) are those of ``failed_pages``. html never reaches a shuffle."""
    from faultline.functions.urls import url_groups

    parts = extract_pages(commit_pages, pages)[0] if parts is None else parts
    linked = linked_parts(commit_pages, pages, parts).where("valid")
    lists = {"pull": "pull_requests", "issue": "issues", "security": "security"}
    # One grouping for all kinds: a list skips the NULLs of the other kinds.
    item = {k: F.when(F.col("kind") == k, F.struct(F.col("url").alias("u"), F.col(k).alias("p"))) for k in lists}
    grouped = linked.groupBy("commit_url").agg(*[F.sort_array(F.collect_list(x)).alias(k) for k, x in item.items()]).select(
        "commit_url", *[empty_to_null(F.transform(k, lambda e: e["p"])).alias(name) for k, name in lists.items()])
    _, _, sha7 = url_groups("commit_url")
    commits = parts.where("kind = 'commit'").select(F.col("url").alias("commit_url"), F.when(F.col("valid"), F.col("commit")).alias("commit"))
    return commits.join(grouped, "commit_url", "left").select(sha7.alias("commit_index"), "commit_url", "commit", "pull_requests", "issues", "security")


def failed_pages(commit_pages: DataFrame, pages: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """K9: (url, kind, html) of the landed pages whose extraction failed: the
    quarantine that the one pass has written."""
    parts = extract_pages(commit_pages, pages)[0] if parts is None else parts
    return parts.where("NOT valid").select("url", "kind", "html")
