"""Page-kind extractors and record assembly on synthetic landed pages."""

import json

from pyspark.sql import functions as F

from faultline.functions import pages as PG
from faultline.operators.records import assemble_records, record_text

COMMIT_URL = "https://github.com/acme/widgets/commit/abc1234def5678"
PR_URL = "https://github.com/acme/widgets/pull/7"
ISSUE_URL = "https://github.com/acme/widgets/issues/9"
OTHER_ISSUE = "https://github.com/acme/widgets/issues/11"
SEC_URL = "https://github.com/acme/widgets/security/advisories/GHSA-1"

COMMIT_JSON = json.dumps({"payload": {"diffEntryData": [{"path": "src/a.ts"}, {"path": "src/b.ts"}],
                                      "commit": {"parents": ["fff0001", "fff0002"]}}})
COMMIT_HTML = (
    "<html><head><title>Fixes crashes on empty input · acme/widgets@abc1234 · GitHub</title></head><body>"
    '<span class="ws-pre-wrap extended-commit-description-container f6">Guard the <b>parser</b><br>Thanks!</span>'
    f'<script type="application/json" data-target="react-app.embeddedData">{COMMIT_JSON}</script>'
    f'<a href="{PR_URL}">pr</a><a href="{ISSUE_URL}">issue</a><a href="https://github.com/acme/widgets/tree/HEAD/issues/x">t</a>'
    f'<a href="{COMMIT_URL}/issues/1">self</a><a href="https://github.com/security/advanced-security">ad</a>'
    "</body></html>")
PR_HTML = (
    '<html><body><h1 class="gh-header-title">Handle empty input</h1>'
    '<div class="comment-body">Adds a guard for empty input.</div><a class="author" href="/ann">ann</a>'
    '<table class="d-block user-select-contain" data-paste-markdown-skip><td class="d-block comment-body markdown-body js-comment-body"><p dir="auto">Looks good, merged the fixes</p></td></table>'
    '<table class="d-block user-select-contain" data-paste-markdown-skip><td class="d-block comment-body markdown-body js-comment-body"><p dir="auto">'
    'The latest updates on your projects. Learn more about Vercel for Git ↗︎</p></td></table>'
    '<table class="d-block user-select-contain" data-paste-markdown-skip><td class="d-block comment-body markdown-body js-comment-body"><p dir="auto"></p></td></table>'
    '<table class="d-block user-select-contain" data-paste-markdown-skip><td class="d-block comment-body markdown-body js-comment-body"><p dir="auto">Second review</p>'
    '<p dir="auto">with details</p></td></table>'
    f'<a href="{OTHER_ISSUE}">i</a><a href="https://github.com/acme/widgets/pull/8">other pr</a><a href="{SEC_URL}">s</a>'
    "</body></html>")
ISSUE_JSON = json.dumps({"payload": {"preloadedQueries": [{"result": {"data": {"repository": {"issue": {
    "frontTimelineItems": {"edges": [
        {"node": {"__typename": "IssueComment", "author": {"login": "bob"}, "body": "Crash reproduced"}},
        {"node": {"__typename": "IssueComment", "author": {"login": "carol"}, "body": "Original reporter here"}},
        {"node": {"__typename": "IssueComment", "author": None, "body": "Anonymous note"}},
        {"node": {"__typename": "IssueComment", "author": {"login": "dan"}, "body": ""}},
        {"node": {"__typename": "LabeledEvent", "author": {"login": "eve"}, "body": "x"}}]}}}}}}]}})
ISSUE_HTML = (
    '<html><body><bdi data-testid="issue-title">App crashes on empty input</bdi>'
    '<span class="TokenBase__StyledTokenBase-x"><span class="prc-Text-Text-0ima0">bug</span></span>'
    '<span class="TokenBase__StyledTokenBase-x"><span class="prc-Text-Text-0ima0">bug</span></span>'
    '<span class="TokenBase__StyledTokenBase-y"><span class="prc-Text-Text-0ima0">crash</span></span>'
    '<a data-testid="issue-body-header-author" href="/carol">carol</a>'
    '<div data-testid="markdown-body"><p>Steps to reproduce</p></div>'
    f'<script type="application/json" data-target="react-app.embeddedData">{ISSUE_JSON}</script>'
    "</body></html>")
BROKEN_ISSUE_HTML = ('<html><body><bdi data-testid="issue-title">Broken</bdi>'
                     '<script type="application/json" data-target="react-app.embeddedData">{not json</script></body></html>')
SEC_HTML = ('<html><body><h1 class="gh-header-title">Prototype pollution</h1>'
            '<div class="markdown-body comment-body p-0"><p>Affected versions</p><p>Patched in 2.0</p></div></body></html>')


def test_commit_page(spark):
    df = spark.createDataFrame([(COMMIT_HTML,)], "html string")
    c = df.select(PG.commit_page("html").alias("c")).first().c
    assert c.commit_message == ["fix", "crash", "empty", "input"]
    assert c.description == ["guard", "parser"]
    assert c.changed_files == ["src/a.ts", "src/b.ts"] and c.changed_files_count == 2
    assert c.parent == "fff0001"


def test_pr_page(spark):
    df = spark.createDataFrame([(PR_HTML,)], "html string")
    p = df.select(PG.pr_page("html").alias("p")).first().p
    assert p.pr_title == ["handle", "empty", "input"]
    assert [d.discussion_number for d in p.discussions] == [1, 2, 3]
    first = p.discussions[0].comments[0]
    assert (first.type, first.author) == ("pr_description", "ann")
    assert p.discussions[2].comments[0].content == ["second", "review", "detail"]
    assert p.discussions[2].comments[0].author is None
    assert p.total_discussions == 3


def test_issue_page_and_broken_json(spark):
    df = spark.createDataFrame([(ISSUE_HTML,), (BROKEN_ISSUE_HTML,)], "html string")
    rows = df.select(PG.issue_page("html").alias("i"), PG.issue_page_valid(PG.issue_page("html")).alias("ok")).collect()
    i = rows[0].i
    assert i.title == ["app", "crash", "empty", "input"]
    assert i.labels == ["bug", "crash"]
    assert [(c.author, c.content) for c in i.comments] == [
        ("carol", ["step", "reproduce"]), ("bob", ["crash", "reproduced"]), ("Unknown", ["anonymous", "note"])]
    assert rows[1].i.comments == [] and rows[1].ok is False


def test_security_page(spark):
    df = spark.createDataFrame([(SEC_HTML,)], "html string")
    s = df.select(PG.security_page("html").alias("s")).first().s
    assert s.title == ["prototype", "pollution"]
    assert s.content == ["affected", "version", "patched", "2.0"]


def test_assemble_records(spark):
    pages = spark.createDataFrame([(COMMIT_URL, COMMIT_HTML), (PR_URL, PR_HTML), (ISSUE_URL, ISSUE_HTML),
                                   (OTHER_ISSUE, BROKEN_ISSUE_HTML), (SEC_URL, SEC_HTML)], "url string, html string")
    commits = pages.where(F.col("url") == COMMIT_URL).withColumnRenamed("url", "commit_url")
    rec = assemble_records(commits, pages).first()
    assert rec.commit_index == "abc1234"
    assert len(rec.pull_requests) == 1
    assert len(rec.issues) == 1            # the broken issue page is quarantined
    assert [s.title for s in rec.security] == [["prototype", "pollution"]]
    text = assemble_records(commits, pages).select(
        record_text(F.struct("commit", "pull_requests", "issues", "security")).alias("t")).first().t
    assert text.startswith("fix crash empty input | guard parser | src/a.ts src/b.ts | handle empty input")
    assert "Issue title:app crash empty input" in text


def test_nested_markup_keeps_all_text(spark):
    pr = ('<h1 class="gh-header-title">T</h1><div class="comment-body"><div>alpha beta</div><p>gamma delta</p></div>'
          '<table class="d-block user-select-contain" data-paste-markdown-skip><tr>'
          '<td class="d-block comment-body markdown-body js-comment-body"><p dir="auto">green</p><table><tr><td>cell</td></tr></table>'
          '<p>left out</p><p dir="auto">purple</p></td></tr></table>'
          '<table><td class="d-block comment-body markdown-body js-comment-body"><p dir="auto">no discussion</p></td></table>')
    commit = ('<title>m · x</title><span class="extended-commit-description-container">crash <span>when</span> renderer stops</span>'
              '<script data-target="react-app.embeddedData">{bad</script>'
              f'<script data-target="react-app.embeddedData">{COMMIT_JSON}</script>')
    issue = ('<span class="TokenBase__StyledTokenBase-x">plain</span><span>outside</span>'
             '<span class="TokenBase__StyledTokenBase-y"><i></i><span class="prc-Text-Text-0ima0">wanted</span></span>'
             '<div data-testid="markdown-body"><div>first</div>second</div>')
    row = spark.createDataFrame([(pr, commit, issue)], "p string, c string, i string").select(
        PG.pr_page("p").alias("p"), PG.commit_page("c").alias("c"), PG.issue_page("i").alias("i")).first()
    assert [c.content for d in row.p.discussions for c in d.comments] == [["alpha", "beta", "gamma", "delta"], ["green", "purple"]]
    assert row.c.description == ["crash", "renderer", "stop"] and row.c.changed_files == ["src/a.ts", "src/b.ts"]
    assert row.i.labels == ["wanted"] and row.i.comments[0].content == ["first", "second"]


def test_failed_commit_page_keeps_its_record(spark):
    from faultline.operators.records import failed_pages, linked_parts
    bad = f'<html><a href="{PR_URL}">pr</a></html>'
    pages = spark.createDataFrame([(COMMIT_URL, bad), (PR_URL, PR_HTML), (OTHER_ISSUE, BROKEN_ISSUE_HTML), (SEC_URL, SEC_HTML)], "url string, html string")
    commits = pages.where(F.col("url") == COMMIT_URL).withColumnRenamed("url", "commit_url")
    rec = assemble_records(commits, pages).collect()
    assert len(rec) == 1 and rec[0].commit is None and len(rec[0].pull_requests) == 1 and rec[0].issues is None
    assert {(r.url, r.kind, r.html) for r in failed_pages(commits, pages).collect()} == {(COMMIT_URL, "commit", bad), (OTHER_ISSUE, "issue", BROKEN_ISSUE_HTML)}
    assert {(r.url, r.hop) for r in linked_parts(commits, pages).collect()} == {(PR_URL, 1), (OTHER_ISSUE, 2), (SEC_URL, 2)}


def test_first_query_of_each_script_and_shapes_that_change(spark):
    node = lambda who, body, **more: {"node": {"__typename": "IssueComment", "author": {"login": who}, "body": body} | more}
    query = lambda *nodes: {"result": {"data": {"repository": {"issue": {"frontTimelineItems": {"edges": list(nodes)}}}}}}
    script = lambda x: f'<script type="application/json" data-target="react-app.embeddedData">{json.dumps(x)}</script>'
    html = [
        # Two queries: the first counts, of each script.
        script({"payload": {"preloadedQueries": [query(node("a", "alpha")), query(node("b", "beta"))]}})
        + script({"payload": {"preloadedQueries": [query(node("c", "gamma"))]}}),
        # Keys added, missing, of another type.
        script({"payload": {"preloadedQueries": [query(node("a", "alpha", extra=[1, {"x": 2}]), {"node": {"__typename": "IssueComment", "body": "delta"}},
                                                       {"node": {"__typename": "IssueComment", "author": "text", "body": "eta"}}, {"nodes": 1}, 7,
                                                       {"node": {"__typename": "IssueComment", "author": {"login": "z"}, "body": ["list"]}})], "new": {}}}),
        script({"payload": {"preloadedQueries": {"result": 1}}}), script({"payload": []}), script([]), script({"payload": {"preloadedQueries": []}}),
    ]
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(html)], "i int, h string").select("i", PG.issue_page("h").alias("p")).collect()
    got = {r.i: [(c.author, c.content) for c in r.p.comments] for r in rows}
    assert got[0] == [("a", ["alpha"]), ("c", ["gamma"])]
    assert got[1] == [("a", ["alpha"]), ("Unknown", ["delta"]), ("Unknown", ["eta"])]
    assert all(got[i] == [] for i in range(2, 6))
    commit = script({"payload": {"diffEntryData": [{"path": "a.ts", "n": 1}, {"file": "x"}, {"path": 5}], "commit": {"parents": "none"}}})
    c = spark.createDataFrame([(commit,)], "h string").select(PG.commit_page("h").alias("c")).first().c
    assert c.changed_files == ["a.ts", None, None] and c.parent == "" and c.changed_files_count == 3


def test_comments_and_scripts_are_not_markup(spark):
    pr = ('<!-- <h1 class="gh-header-title">old</h1> --><h1 class="gh-header-title" title="a>b">new title</h1><div class="comment-body">alpha<!-- </div> -->'
          '<script>"</div>"</script><br>beta</div><table class="d-block user-select-contain" data-paste-markdown-skip="true"><tr><td '
          'class="d-block comment-body markdown-body js-comment-body"><p dir="auto">green<p dir=\'auto\'>purple<p>none</td></tr></table>')
    p = spark.createDataFrame([(pr,)], "h string").select(PG.pr_page("h").alias("p")).first().p
    assert p.pr_title == ["new", "title"]
    assert [c.content for d in p.discussions for c in d.comments] == [["alpha", "beta"], ["green", "purple"]]


def test_each_page_is_extracted_once_to_two_outputs(spark):
    from faultline.operators.records import extract_pages
    pages = spark.createDataFrame([(PR_URL, PR_HTML), (ISSUE_URL, ISSUE_HTML), (OTHER_ISSUE, BROKEN_ISSUE_HTML), (SEC_URL, SEC_HTML), (SEC_URL + "2", None),
                                   ("https://example.com/", "other")], "url string, html string")
    commits = spark.createDataFrame([(COMMIT_URL, COMMIT_HTML), (COMMIT_URL + "9", None)], "commit_url string, html string")
    parts, seen = extract_pages(commits, pages)
    assert seen == {"pages": 7, "good": 4, "failed": 3}
    assert {(r.url, r.html) for r in parts.where("NOT valid").collect()} == {(OTHER_ISSUE, BROKEN_ISSUE_HTML), (SEC_URL + "2", None), (COMMIT_URL + "9", None)}
    assert parts.where("valid AND html IS NOT NULL").count() == 0
    # The quarantine is a folder of its own.
    assert all("valid=false" in f for f in parts.where("NOT valid").selectExpr("_metadata.file_path AS f").toPandas().f)


def test_bad_record_files_are_put_aside(spark, scratch):
    import os
    from faultline.sources.readers import land_commit_records
    src = os.path.join(scratch, "records")
    os.makedirs(src)
    for name, text in (("a.json", json.dumps({"commit_index": "abc1234", "commit_url": COMMIT_URL, "commit": {"commit_message": ["x"]}})),
                       ("b.json", '{"commit_index": "bro'), ("c.json", "{}"), ("d.txt", "no")):
        with open(os.path.join(src, name), "w") as f:
            f.write(text)
    good, bad, seen = land_commit_records(spark, src, os.path.join(scratch, "landed"))
    assert seen == {"files": 3, "good": 1, "bad": 2}
    assert [(r.commit_index, r.commit.commit_message) for r in good.collect()] == [("abc1234", ["x"])]
    assert {(os.path.basename(r.file), (r.content or "")[:5]) for r in bad.collect()} == {("b.json", '{"com'), ("c.json", "")}


def test_extraction_is_dealt_by_bytes_of_text(spark, scratch, monkeypatch):
    from faultline.plans import collected
    monkeypatch.setattr(collected, "TASK_BYTES", 1000)
    rows = [(c, t, "user", "x" * 50) for c in range(200) for t in range(2)] + [(200, 0, "user", None), (None, 0, "user", "y")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{scratch}/conversations.parquet")
    commits, pages = collected.landed(spark, scratch)
    assert pages.rdd.getNumPartitions() == commits.rdd.getNumPartitions() == 21
    assert commits.count() == 202
