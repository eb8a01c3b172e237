"""Registered queries of sources and sinks (S1-S9, K1-K7, K10, X1): each writes what a
given table holds to a new folder beside ``spark.checkpoint.dir``'s other tables and
returns what the matching reader finds there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.plans import labelling as L
from faultline.session import checkpoint_dir
from faultline.sources import manifest, readers, sinks
from faultline.sources.tables import table
from faultline.streaming import ingest

QUERIES = ["predictions_committed", "records_rewritten", "urls_rewritten", "summary_rewritten", "verification_rewritten",
           "matrix_rewritten", "report_rewritten", "matrix_rows_text", "gold_rewritten", "repositories_rewritten", "tasks_rewritten",
           "listing_rewritten", "landed_content", "ingested_records"]

MATRIX_COLUMNS = ["click", "error", "purchase", "signup", "view"]


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def predictions_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: two model versions; the first batch is written twice, and an attempt of it and
    of a third batch is never committed. Each prediction is there once."""
    path, pred = _folder(spark, "predictions"), L._predicted(spark, sf_dir)
    manifest.stage_batch(pred, path, "job-1", "v1")
    manifest.write_predictions(pred, path, "job-1", "v1")
    manifest.write_predictions(pred, path, "job-1", "v1")
    manifest.write_predictions(pred.where("predicted = 'quality_1'"), path, "job-2", "v2")
    manifest.stage_batch(pred, path, "job-3", "v2")
    return manifest.read_predictions(spark, path, "doc_id long, predicted string").select("doc_id", "predicted", "model_version", "batch")


def _records(spark, sf_dir) -> DataFrame:
    """A commit record a conversation: its first turn is the message, the others one pull request."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split(F.coalesce("text", F.lit("")), " ").alias("words"))
    turns = conv.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "words"))).alias("t"))
    key = F.substring(F.md5(F.col("conv_id").cast("string")), 1, 7)
    comment = lambda x: F.struct(F.lit(None).cast("string").alias("type"), x["words"].alias("content"), F.lit(None).cast("string").alias("author"))
    talk = F.transform(F.slice("t", 2, F.size("t")), lambda x, i: F.struct((i + 1).cast("int").alias("discussion_number"), F.array(comment(x)).alias("comments")))
    none = F.array().cast("array<string>")
    return turns.select(
        key.alias("commit_index"), F.concat(F.lit("https://github.com/o"), (F.col("conv_id") % 5).cast("string"), F.lit("/r/commit/"), key).alias("commit_url"),
        F.struct(F.get("t", 0)["words"].alias("commit_message"), none.alias("description"), F.lit(0).alias("changed_files_count"), none.alias("changed_files"),
                 F.array().cast("array<struct<before:string,after:string>>").alias("changed_files_content"), F.lit("").alias("parent")).alias("commit"),
        F.when(F.size("t") > 1, F.array(F.struct(none.alias("pr_title"), F.size(talk).cast("int").alias("total_discussions"), talk.alias("discussions")))).otherwise(
            F.array().cast("array<struct<pr_title:array<string>,total_discussions:int,discussions:array<struct<discussion_number:int,"
                           "comments:array<struct<type:string,content:array<string>,author:string>>>>>>")).alias("pull_requests"))


def records_rewritten(spark, sf_dir):
    """Nested records as JSON lines by repository, read with the fixed schema; an
    empty list comes back as NULL."""
    path = _folder(spark, "records")
    sinks.write_commit_records(_records(spark, sf_dir), path, "json")
    back = spark.read.schema(readers.COMMIT_RECORD_SCHEMA + ", repo string").json(path)
    return back.select("commit_index", "repo", F.size("commit.commit_message").alias("n_words"), F.col("pull_requests").isNull().alias("no_pulls"),
                       F.get("pull_requests", 0)["total_discussions"].alias("n_discussions"), F.col("security").isNull().alias("no_security"))


def urls_rewritten(spark, sf_dir):
    """Accepted URLs by repository, written sorted and read again."""
    path = _folder(spark, "urls")
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("repo"), "url")
    sinks.write_url_list(pages, path)
    return spark.read.schema("repo string, url string").json(path)


def summary_rewritten(spark, sf_dir):
    """The long prediction summary: every (category, index), and its category's count."""
    path = _folder(spark, "summary")
    sinks.write_prediction_summary(L._predicted(spark, sf_dir), path, "doc_id", "predicted")
    rows, counts = readers.read_summary_rows(spark, path)
    return rows.join(counts, "category").select("category", "index", "count")


def verification_rewritten(spark, sf_dir):
    """Correct and wrong predictions as two CSV tables."""
    path = _folder(spark, "verified")
    sinks.write_verification(L.verify_predictions(spark, sf_dir), path, "gold", "doc_id")
    out = None
    for name in ("correct", "wrong"):
        part = spark.read.option("header", True).schema("doc_id long, predicted string, gold string, is_correct boolean").csv(f"{path}/{name}")
        part = part.select("doc_id", "predicted", "gold", F.lit(name).alias("sheet"))
        out = part if out is None else out.unionByName(part)
    return out


def _counts(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("user_id", "event_type")
    return ev.groupBy(F.col("user_id").cast("string").alias("user"), "event_type").agg(F.count("*").alias("n"))


def matrix_rewritten(spark, sf_dir):
    """The user by event-type matrix as CSV with row names."""
    path = _folder(spark, "matrix")
    sinks.write_matrix_csv(_counts(spark, sf_dir), path, "user", "event_type", "n", MATRIX_COLUMNS)
    return readers.read_csv_table(spark, path, "user string, " + ", ".join(f"{c} long" for c in MATRIX_COLUMNS), r_names=False)


def matrix_rows_text(spark, sf_dir):
    """Matrix rows as 'a & b & ...' lines, written and read as text."""
    path = _folder(spark, "rows")
    wide = _counts(spark, sf_dir).groupBy("user").pivot("event_type", MATRIX_COLUMNS).agg(F.first("n")).na.fill(0)
    sinks.format_rows(wide, ["user", *MATRIX_COLUMNS]).write.text(path)
    return spark.read.text(path).withColumnRenamed("value", "line")


def report_rewritten(spark, sf_dir):
    """K6: the text report of predictions, read again block by block."""
    path = _folder(spark, "report")
    p = F.when(F.col("predicted") == "quality_1", F.lit(0.875)).otherwise(F.lit(0.25))
    pred = L._predicted(spark, sf_dir).withColumn("confidence", p).withColumn("class_probs", F.create_map(F.lit("good"), p, F.lit("bad"), 1 - p))
    sinks.write_prediction_report(pred, path, "doc_id")
    blocks = spark.read.option("lineSep", "\n\n").text(path).where("value != ''")
    part = lambda name: F.regexp_extract("value", rf"(?m)^{name}: (.*)$", 1)
    return blocks.select(part("id").cast("long").alias("doc_id"), part("label").alias("label"), part("confidence").alias("confidence"),
                         part("probabilities").alias("probabilities"))


def gold_rewritten(spark, sf_dir):
    """S3: gold labels as one {"index": {key: label}} object a hundred keys, read as rows."""
    path = _folder(spark, "gold")
    gold = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q IS NOT NULL")
    entry = F.struct(F.col("doc_id").cast("string").alias("key"), F.col("q").cast("string").alias("value"))
    gold.groupBy(F.floor(F.col("doc_id") / 100)).agg(F.map_from_entries(F.collect_list(entry)).alias("index")).select("index").write.json(path)
    raw = spark.read.schema(readers.GOLD_SCHEMA).json(path)
    return raw.select(F.explode("index").alias("commit_index", "label"))


def repositories_rewritten(spark, sf_dir):
    """The fixed repository list in its order, joined to the documents of each."""
    path = _folder(spark, "repositories")
    spark.createDataFrame([(L.REPOS,)], readers.REPOSITORY_SCHEMA).coalesce(1).write.json(path)
    listed = readers.read_repository_list(spark, path)
    n = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("repository")).agg(F.count("*").alias("n"))
    return listed.join(n, "repository", "left").select("position", "repository", F.coalesce("n", F.lit(0)).alias("n_documents"))


def tasks_rewritten(spark, sf_dir):
    """Exported label tasks of two projects; those of one, with their first choice."""
    from faultline.operators.tasks import first_choice
    path = _folder(spark, "tasks")
    gold = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("q"))
    docs = table(spark, sf_dir, "documents").select("doc_id").distinct().join(gold, "doc_id", "left")
    choice = F.array(F.struct(F.struct(F.array(F.concat(F.lit("q"), F.col("q").cast("string"))).alias("choices")).alias("value")))
    tasks = docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 2).alias("project"),
                        F.struct(F.col("doc_id").cast("string").alias("commit_index")).alias("data"),
                        F.when(F.col("q").isNotNull(), F.array(F.struct(choice.alias("result")))).alias("annotations"))
    tasks.write.json(path)
    back = readers.read_label_tasks(spark, path, 1, multi_line=False)
    return back.select("id", F.col("data.commit_index").alias("commit_index"), first_choice(F.col("annotations")).alias("choice"))


def listing_rewritten(spark, sf_dir):
    """Landed commit listings within a window, titles from the first line."""
    path = _folder(spark, "listing")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    day = F.date_add(F.lit("2023-01-01").cast("date"), (F.col("doc_id") % 400).cast("int")).cast("string")
    docs.select(F.sha1(F.col("doc_id").cast("string")).alias("sha"), F.concat(F.lit("https://github.com/o/r/commit/"), F.col("doc_id").cast("string")).alias("html_url"),
                F.struct(F.col("text").alias("message"), F.struct(F.lit("a").alias("name"), F.concat(day, F.lit("T00:00:00Z")).alias("date")).alias("author")).alias("commit")) \
        .write.json(path)
    rows = readers.read_commit_listing(spark, path, "2023-03-01", "2023-06-30", multi_line=False)
    return rows.select("sha", "title", "url")


def landed_content(spark, sf_dir):
    """The html of wanted URLs, NULL for those that were never landed."""
    pages = table(spark, sf_dir, "pages").select("url", "html")
    wanted = pages.select("url").unionByName(pages.select(F.concat("url", F.lit("/missing")).alias("url")))
    return readers.page_content(wanted, pages.groupBy("url").agg(F.min("html").alias("html"))).select("url", F.md5("html").alias("digest"))


def ingested_records(spark, sf_dir):
    """Every document as two files of a watched folder; the stream, its state bounded
    by a horizon on the files' times, keeps one row a key."""
    src, out = _folder(spark, "watched"), _folder(spark, "ingested")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n_chars"))
    for _ in range(2):
        docs.write.mode("append").parquet(src)
    stream = spark.readStream.schema("doc_id long, n_chars int").option("maxFileAge", ingest.MAX_FILE_AGE).option("pathGlobFilter", "*.parquet").parquet(src)
    kept = ingest.drop_copies(stream, ["doc_id"], "30 days")
    kept.writeStream.format("parquet").outputMode("append").option("checkpointLocation", _folder(spark, "ingest")).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("doc_id long, n_chars int").parquet(out)


def oracles() -> dict[str, str]:
    pred = f"SELECT doc_id, CASE WHEN n_chars >= {L.PRED_MIN_CHARS} THEN 'quality_1' ELSE 'quality_0' END AS predicted FROM documents"
    gold = "SELECT doc_id, 'quality_' || CAST(min(quality) AS VARCHAR) AS gold FROM labels GROUP BY doc_id"
    cells = ", ".join(f"nullif(count(*) FILTER (WHERE event_type = '{c}'), 0) AS {c}" for c in MATRIX_COLUMNS)
    counts = " || ' & ' || ".join(f"count(*) FILTER (WHERE event_type = '{c}')" for c in MATRIX_COLUMNS)
    return {
        "predictions_committed": f"SELECT *, 'v1' AS model_version, 'job-1' AS batch FROM ({pred}) UNION ALL "
                                 f"SELECT *, 'v2', 'job-2' FROM ({pred}) WHERE predicted = 'quality_1'",
        "records_rewritten": """
SELECT substr(md5(CAST(conv_id AS VARCHAR)), 1, 7) AS commit_index, 'o' || (conv_id % 5) || '_r' AS repo,
  CAST(len(string_split(coalesce(first(text ORDER BY turn), ''), ' ')) AS INT) AS n_words, count(*) < 2 AS no_pulls,
  CAST(CASE WHEN count(*) > 1 THEN count(*) - 1 END AS INT) AS n_discussions, TRUE AS no_security
FROM conversations GROUP BY conv_id""",
        "urls_rewritten": "SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS repo, url FROM pages",
        "summary_rewritten": f"SELECT predicted AS category, CAST(doc_id AS VARCHAR) AS index, count(*) OVER (PARTITION BY predicted) AS count "
                             f"FROM ({pred}) WHERE doc_id IS NOT NULL",
        "verification_rewritten": f"SELECT doc_id, predicted, gold, CASE WHEN predicted = gold THEN 'correct' ELSE 'wrong' END AS sheet "
                                  f"FROM ({pred}) JOIN ({gold}) USING (doc_id) WHERE gold IS NOT NULL",
        "matrix_rewritten": f"SELECT CAST(user_id AS VARCHAR) AS user, {cells} FROM events GROUP BY user_id",
        "matrix_rows_text": f"SELECT user_id || ' & ' || {counts} AS line FROM events GROUP BY user_id",
        "report_rewritten": f"SELECT doc_id, predicted AS label, CASE WHEN predicted = 'quality_1' THEN '0.875' ELSE '0.250' END AS confidence, "
                            f"CASE WHEN predicted = 'quality_1' THEN 'good: 0.8750, bad: 0.1250' ELSE 'good: 0.2500, bad: 0.7500' END AS probabilities FROM ({pred})",
        "gold_rewritten": "SELECT CAST(doc_id AS VARCHAR) AS commit_index, CAST(min(quality) AS VARCHAR) AS label FROM labels "
                          "GROUP BY doc_id HAVING min(quality) IS NOT NULL",
        "repositories_rewritten": "WITH r AS (SELECT CAST(i AS INT) AS position, 'src' || i AS repository FROM range(10) t(i)) "
                                  "SELECT position, repository, (SELECT count(*) FROM documents WHERE source = repository) AS n_documents FROM r",
        "tasks_rewritten": "SELECT DISTINCT d.doc_id AS id, CAST(d.doc_id AS VARCHAR) AS commit_index, 'q' || q AS choice FROM documents d "
                           "LEFT JOIN (SELECT doc_id, min(quality) AS q FROM labels GROUP BY doc_id) l USING (doc_id) WHERE d.doc_id % 2 = 1",
        "listing_rewritten": "SELECT sha1(CAST(doc_id AS VARCHAR)) AS sha, string_split(text, chr(10))[1] AS title, 'https://github.com/o/r/commit/' || doc_id AS url "
                             "FROM documents WHERE DATE '2023-01-01' + CAST(doc_id % 400 AS INT) BETWEEN DATE '2023-03-01' AND DATE '2023-06-30'",
        "landed_content": "SELECT url, md5(h) AS digest FROM pages JOIN (SELECT url, min(html) AS h FROM pages GROUP BY url) USING (url) "
                          "UNION ALL SELECT url || '/missing', NULL FROM pages",
        "ingested_records": "SELECT doc_id, CAST(min(length(text)) AS INT) AS n_chars FROM documents GROUP BY doc_id",
    }
