"""Readers for the JSON, CSV and listing inputs.

Every reader takes a fixed schema (no inference: JSON inference would lose
the always-NULL ``security`` and always-empty ``changed_files_content``).
One-object JSON files are not splittable; convert them to Parquet once
(``sinks.write_commit_records``) before heavy use.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.labels import r_name
from faultline.functions.text import first_line

COMMIT_STRUCT = (
    "struct<commit_message:array<string>, description:array<string>, changed_files_count:int, "
    "changed_files:array<string>, changed_files_content:array<struct<before:string,after:string>>, "
    "parent:string>"
)
COMMIT_RECORD_SCHEMA = (
    "commit_index string, commit_url string, "
    f"commit {COMMIT_STRUCT}, "
    "pull_requests array<struct<pr_title:array<string>, total_discussions:int, "
    "discussions:array<struct<discussion_number:int, "
    "comments:array<struct<type:string,content:array<string>,author:string>>>>>>, "
    "issues array<struct<title:array<string>, labels:array<string>, "
    "comments:array<struct<author:string,content:array<string>>>>>, "
    "security array<struct<title:array<string>, content:array<string>>>"
)
CRAWL_JOB_SCHEMA = "token string, urls array<string>, _corrupt_record string"
GOLD_SCHEMA = "index map<string,string>"
SUMMARY_SCHEMA = (
    "summary struct<total_tasks:int,tasks_with_predictions:int,tasks_without_predictions:int,"
    "total_categories:int>, categories map<string,struct<count:int,indices:array<string>>>"
)
REPOSITORY_SCHEMA = "repository_name array<string>"
_RESULT = "array<struct<value:struct<choices:array<string>>>>"
LABEL_TASK_SCHEMA = (
    f"id long, project long, data struct<commit_index:string, commit_url:string, commit:{COMMIT_STRUCT}, "
    "pull_requests:array<struct<pr_title:array<string>, total_discussions:int, "
    "discussions:array<struct<discussion_number:int, "
    "comments:array<struct<type:string,content:array<string>,author:string>>>>>>, "
    "issues:array<struct<title:array<string>, labels:array<string>, "
    "comments:array<struct<author:string,content:array<string>>>>>, "
    "security:array<struct<title:array<string>, content:array<string>>>>, "
    f"annotations array<struct<result:{_RESULT}>>, predictions array<struct<result:{_RESULT}>>"
)
LISTING_SCHEMA = ("sha string, html_url string, "
                  "commit struct<message:string, author:struct<name:string, date:timestamp>>")


def _json(spark: SparkSession, schema: str, multi_line: bool = True):
    return (spark.read.schema(schema).option("multiLine", multi_line)
            .option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true"))


def read_commit_records(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """One nested commit record per ``*.json`` file under ``path``."""
    return _json(spark, COMMIT_RECORD_SCHEMA).option("mode", mode).json(path)


def land_commit_records(spark: SparkSession, path: str, out: str) -> tuple[DataFrame, DataFrame, dict]:
    """S1 + K9: (records, bad files, counts) in one pass over ``*.json`` files. A file that is
    no JSON, or has no ``commit_index``, is bad: (file, content as read). The pass is
    written to ``out`` by ``bad``; the counts (files, good, bad) are those of what was written."""
    raw = _json(spark, f"{COMMIT_RECORD_SCHEMA}, _corrupt_record string").option("mode", "PERMISSIVE") \
        .option("columnNameOfCorruptRecord", "_corrupt_record").json(path).select("*", F.col("_metadata.file_path").alias("file"))
    raw = raw.withColumn("bad", F.col("_corrupt_record").isNotNull() | F.col("commit_index").isNull())
    raw.write.mode("overwrite").partitionBy("bad").parquet(out)
    landed = spark.read.schema(raw.schema).parquet(out)
    n = {r["bad"]: r["n"] for r in landed.groupBy("bad").agg(F.count("*").alias("n")).collect()}
    return (landed.where("NOT bad").drop("bad", "file", "_corrupt_record"),
            landed.where("bad").select("file", F.col("_corrupt_record").alias("content")), {"files": sum(n.values()), "good": n.get(False, 0), "bad": n.get(True, 0)})


def read_crawl_job(spark: SparkSession, path: str) -> DataFrame:
    """Crawl job URLs, one row per URL. Malformed files land in
    ``_corrupt_record`` and give no URL; the token is never selected."""
    raw = _json(spark, CRAWL_JOB_SCHEMA).option("mode", "PERMISSIVE") \
        .option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return raw.select(F.explode(F.coalesce(F.col("urls"), F.array().cast("array<string>"))).alias("url"))


def read_gold_labels(spark: SparkSession, path: str) -> DataFrame:
    """S3: (commit_index, label) rows out of ``{"index": {key: label}}``."""
    raw = _json(spark, GOLD_SCHEMA).json(path)
    return raw.select(F.explode("index").alias("commit_index", "label"))


def read_prediction_summary(spark: SparkSession, path: str) -> DataFrame:
    """(category, index) rows out of a prediction summary."""
    raw = _json(spark, SUMMARY_SCHEMA).json(path)
    cats = raw.select(F.explode("categories").alias("category", "entry"))
    return cats.select("category", F.explode("entry.indices").alias("index"))


def read_summary_rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S4 for what ``sinks.write_prediction_summary`` writes: (category, index)
    rows and (category, count) rows."""
    return (spark.read.schema("category string, index string").json(f"{path}/categories"),
            spark.read.schema("category string, count long").json(f"{path}/counts"))


def read_repository_list(spark: SparkSession, path: str) -> DataFrame:
    """(position, repository) keeping list order."""
    raw = _json(spark, REPOSITORY_SCHEMA).json(path)
    return raw.select(F.posexplode("repository_name").alias("position", "repository"))


def read_csv_table(spark: SparkSession, path: str, schema: str | None = None,
                   r_names: bool = True) -> DataFrame:
    """CSV with a header; typed by ``schema`` (or read as strings and
    cast later with ``labels.to_numeric``); optional R-style name mangling
    (``Size (LOC)`` -> ``Size..LOC.``)."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    if r_names:
        df = df.toDF(*[r_name(c) for c in df.columns])
    return df


def read_label_tasks(spark: SparkSession, path: str, project_id: int | None = None, multi_line: bool = True) -> DataFrame:
    """Exported label tasks, optionally of one project; ``multi_line`` False: a task a line."""
    df = _json(spark, LABEL_TASK_SCHEMA, multi_line).json(path)
    return df.where(F.col("project") == project_id) if project_id is not None else df


def page_content(urls: DataFrame, pages: DataFrame, url_col: str = "url") -> DataFrame:
    """S8 (re-aimed): page HTML by URL from landed pages; NULL html when the
    page was not landed (a failed fetch)."""
    return urls.join(pages.select(url_col, "html"), url_col, "left")


def read_commit_listing(spark: SparkSession, path: str, since: str | None = None,
                        until: str | None = None, multi_line: bool = True) -> DataFrame:
    """S9 + F2 (re-aimed): landed commit-listing JSON arrays (``multi_line`` False: a
    commit a line) -> (sha, title, url, ts); optional inclusive time window."""
    raw = spark.read.schema(LISTING_SCHEMA).option("multiLine", multi_line).json(path)
    out = raw.select("sha", first_line(F.col("commit.message")).alias("title"),
                     F.col("html_url").alias("url"), F.col("commit.author.date").alias("ts"))
    if since is not None and until is not None:
        if datetime.fromisoformat(str(since)) > datetime.fromisoformat(str(until)):
            raise ValueError("invalid window: since is after until")
        out = out.where(F.col("ts").between(F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp")))
    return out
