"""Page-kind extractors: commit, pull request, issue and security pages
(P6-P13), as Column functions from the raw html to the record parts.

Each returns a struct shaped like the matching part of the commit record
(``readers.COMMIT_RECORD_SCHEMA``) with token bags already cleaned. Embedded
JSON is read as VARIANT by path: bad or missing JSON, and keys that are added,
missing or of another type, leave the other fields as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.html import every, first, inner, inside, lines_of, once, paragraphs_of, parts, script_texts, scripts, start_tag, text_of, title
from faultline.functions.text import clean_tokens, is_bot_comment

# ---------------------------------------------------------------------------
# Markup the extractors look for on each page kind.
COMMIT_DESCRIPTION_CLASS = "extended-commit-description-container"
EMBEDDED_DATA_TARGET = "react-app.embeddedData"
EMBEDDED_DATA_ATTR = f'data-target="{EMBEDDED_DATA_TARGET}"'
PR_TITLE_CLASS = "gh-header-title"
PR_BODY_CLASS = "comment-body"
PR_AUTHOR_CLASS = "author"
PR_COMMENT_CELL_CLASS = "d-block comment-body markdown-body js-comment-body"
ISSUE_TITLE_TESTID = "issue-title"
ISSUE_AUTHOR_TESTID = "issue-body-header-author"
ISSUE_BODY_TESTID = "markdown-body"
ISSUE_LABEL_CLASS_PATTERN = "TokenBase__StyledTokenBase"
ISSUE_LABEL_TEXT_CLASS = "prc-Text-Text-0ima0"
PR_TABLE_CLASS = "d-block user-select-contain"
PR_TABLE_ATTR = "data-paste-markdown-skip"
PR_PARAGRAPH_DIR = "auto"
SECURITY_TITLE_CLASS = "gh-header-title"
SECURITY_BODY_CLASS = "markdown-body comment-body p-0"
# Bot posts: both phrases of a pair in the first paragraph.
BOT_PHRASES = [
    ("The latest updates on your projects. Learn more", "for Git ↗︎"),
    ("This pull request has been ignored for the connected", "because there are no changes detected"),
]
# ---------------------------------------------------------------------------

# Paths into the embedded JSON of commit pages, and of issue pages (the first preloaded query only).
COMMIT_FILES = "$.payload.diffEntryData"
COMMIT_PARENTS = "$.payload.commit.parents"
ISSUE_TIMELINE = "$.payload.preloadedQueries[0].result.data.repository.issue.frontTimelineItems.edges"
COMMENTS = "array<struct<author:string,content:array<string>>>"
DATA_SCRIPT = start_tag("script", data_target=EMBEDDED_DATA_TARGET)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def embedded_json(html) -> Column:
    """The embedded-data scripts as VARIANT values; bad JSON is a null element."""
    return F.transform(scripts(html, DATA_SCRIPT), F.try_parse_json)


def variant_items(values: Column, path: str) -> Column:
    """The items of the array at a path of each value, one after the other, as
    VARIANT. A missing or retyped key, or no JSON, gives none; other keys do not matter."""
    items = F.transform(values, lambda v: F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>")))
    return F.flatten(items)


def variant_text(value: Column, path: str) -> Column:
    """The string at a path of a VARIANT; NULL for values of other types."""
    found = F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(value, path, "string"))


def commit_page(html) -> Column:
    """P6 + P7 + P8 + P12: commit part of a record."""
    page = parts(html, title=title("·"), description=first(start_tag("span", class_pattern=COMMIT_DESCRIPTION_CLASS), inner(lines_of)), data=script_texts(DATA_SCRIPT))

    def made(p):
        data = F.transform(p["data"], F.try_parse_json)
        return once(F.struct(F.transform(variant_items(data, COMMIT_FILES), lambda e: variant_text(e, "$.path")).alias("files"),
                             variant_text(F.get(variant_items(data, COMMIT_PARENTS), 0), "$").alias("parent")), lambda d: F.struct(
            clean_tokens(p["title"]).alias("commit_message"),
            clean_tokens(p["description"]).alias("description"),
            F.size(d["files"]).cast("int").alias("changed_files_count"),
            d["files"].alias("changed_files"),
            F.array().cast("array<struct<before:string,after:string>>").alias("changed_files_content"),
            F.coalesce(d["parent"], F.lit("")).alias("parent")))
    return once(page, made)


def commit_page_valid(part) -> Column:
    """K9 rule for commit pages: a message or at least one changed file."""
    p = _col(part)
    return (F.size(p["commit_message"]) > 0) | (F.size(p["changed_files"]) > 0)


def pr_page(html) -> Column:
    """P7 + P11 + P13 + F4 + W5 + P12: pull-request part of a record.
    The description is discussion 1 (with type and author); every comment
    cell with a non-empty paragraph whose first paragraph is not a bot post
    becomes the next discussion."""
    # Discussion tables, the first comment cell of each, and its paragraphs of text.
    cell = inside(start_tag("td", PR_COMMENT_CELL_CLASS), inner(paragraphs_of(start_tag("p", dir=PR_PARAGRAPH_DIR))), "CAST(array() AS array<string>)")
    page = parts(html, title=first(start_tag("h1", PR_TITLE_CLASS)), body=first(start_tag("div", PR_BODY_CLASS), inner(text_of, empty=False), "NULL"),
                 author=first(start_tag("a", PR_AUTHOR_CLASS)), paras=every(start_tag("table", PR_TABLE_CLASS, **{PR_TABLE_ATTR: True}), cell))

    def made(p):
        author = F.nullif(p["author"], F.lit(""))
        opening = F.filter(F.array(F.struct(F.lit("pr_description").alias("type"), clean_tokens(p["body"]).alias("content"), author.alias("author"))),
                           lambda c: c["content"].isNotNull())
        kept = F.filter(p["paras"], lambda x: (F.size(x) > 0) & ~is_bot_comment(F.get(x, 0), BOT_PHRASES))
        rest = F.transform(kept, lambda x, i: F.struct(
            (i + 2).cast("int").alias("discussion_number"),
            F.array(F.struct(F.lit(None).cast("string").alias("type"),
                             clean_tokens(F.array_join(x, "\n")).alias("content"),
                             F.lit(None).cast("string").alias("author"))).alias("comments")))
        # A body has tokens, if only none: the description counts by its text.
        return F.struct(clean_tokens(p["title"]).alias("pr_title"),
                        (p["body"].isNotNull().cast("int") + F.size(kept)).cast("int").alias("total_discussions"),
                        F.concat(F.transform(opening, lambda c: F.struct(F.lit(1).alias("discussion_number"), F.array(c).alias("comments"))), rest).alias("discussions"))
    return once(page, made)


def pr_page_valid(part) -> Column:
    """K9 rule for PR pages: at least one discussion."""
    return F.size(_col(part)["discussions"]) > 0


def issue_page(html) -> Column:
    """P7 + P9 + P10 + F13: issue part of a record. Labels are distinct and
    sorted; timeline comments come from the embedded JSON (IssueComment
    nodes with a body, author login or 'Unknown', not the issue author)."""
    get = lambda e, path: variant_text(e, f"$.node.{path}")
    page = parts(html, title=first(start_tag("bdi", data_testid=ISSUE_TITLE_TESTID)), author=first(start_tag("a", data_testid=ISSUE_AUTHOR_TESTID)),
                 labels=every(start_tag("span", class_pattern=ISSUE_LABEL_CLASS_PATTERN), inside(start_tag("span", ISSUE_LABEL_TEXT_CLASS))),
                 body=first(start_tag("div", data_testid=ISSUE_BODY_TESTID), inner(lines_of, empty=False), "NULL"), data=script_texts(DATA_SCRIPT))

    def made(p):
        author = F.nullif(p["author"], F.lit(""))
        main = F.filter(F.array(F.struct(author.alias("author"), clean_tokens(p["body"]).alias("content"))), lambda c: c["content"].isNotNull())
        nodes = F.transform(variant_items(F.transform(p["data"], F.try_parse_json), ISSUE_TIMELINE), lambda e: F.struct(
            get(e, "__typename").alias("kind"), F.coalesce(get(e, "author.login"), F.lit("Unknown")).alias("author"),
            F.coalesce(get(e, "body"), F.lit("")).alias("body")))
        wanted = F.filter(nodes, lambda n: (n["kind"] == "IssueComment") & (n["body"] != "") & ~n["author"].eqNullSafe(author))
        timeline = F.transform(wanted, lambda n: F.struct(n["author"].alias("author"), clean_tokens(n["body"]).alias("content")))
        return F.struct(clean_tokens(p["title"]).alias("title"), F.array_sort(F.array_distinct(F.filter(p["labels"], lambda t: t != ""))).alias("labels"),
                        F.concat(main.cast(COMMENTS), timeline).alias("comments"))
    return once(page, made)


def issue_page_valid(part) -> Column:
    """K9 rule for issue pages: at least one comment."""
    return F.size(_col(part)["comments"]) > 0


def security_page(html) -> Column:
    """Security advisory part of a record (title and body)."""
    page = parts(html, title=first(start_tag("h1", SECURITY_TITLE_CLASS), inner(text_of, empty=False), "NULL"),
                 content=first(start_tag("div", SECURITY_BODY_CLASS), inner(lines_of, empty=False), "NULL"))
    return once(page, lambda p: F.struct(clean_tokens(p["title"]).alias("title"), clean_tokens(p["content"]).alias("content")))
