"""Driver tables standing in for the corpus tables.

* bugs(project, bug_type)      <- events(user_id, event_type)
* projects(project, domain, attributes...) <- customer + per-customer orders
* dependency rows              <- orders(o_custkey, o_orderpriority)
* nested JSON column           <- events.props

Every view is a lazy DataFrame over the Parquet scans; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.labels import parse_grouped_number, recode_label, years_since
from faultline.operators.counts import count_matrix
from faultline.sources.tables import table

# Event types recoded like exported bug labels; 'signup' is not in the map and
# passes through unchanged (the case-sensitive fall-through rule).
EVENT_LABEL_MAP = {"view": "page_view", "click": "ui_click", "purchase": "checkout", "error": "failure"}
# Report order of the recoded types (explicit pivot value list).
TYPE_ORDER = ["failure", "signup", "ui_click", "page_view", "checkout"]
# Numeric project attributes (the projects dimension).
ATTRS = ["loc", "stars", "commits", "issues", "age_years"]
# Fixed as-of date for project age (the original used today's date).
AS_OF_DATE = "1999-01-01"


def bugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return ev.select("event_id", F.col("user_id").alias("project"),
                     recode_label("event_type", EVENT_LABEL_MAP).alias("bug_type"))


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """projects(project, domain, loc_text, loc, stars, commits, issues,
    start_date, age_years). One row per customer."""
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderdate",
                                                  "o_orderstatus")
    per_cust = orders.groupBy("o_custkey").agg(
        F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("_cents"),
        F.count(F.lit(1)).alias("_orders"),
        F.count_if(F.col("o_orderstatus") == "O").alias("_open"),
        F.min(F.to_date("o_orderdate")).alias("start_date"))
    # Grouped-number text, parsed back below.
    loc_text = F.format_number(F.col("_cents"), 0)
    return (cust.join(per_cust, cust.c_custkey == per_cust.o_custkey, "left")
                .select(F.col("c_custkey").alias("project"),
                        F.trim(F.col("c_mktsegment")).alias("domain"),
                        loc_text.alias("loc_text"),
                        F.col("c_acctbal"),
                        F.coalesce(F.col("_orders"), F.lit(0)).alias("commits"),
                        F.coalesce(F.col("_open"), F.lit(0)).alias("issues"),
                        F.col("start_date"))
                .select("project", "domain", "loc_text",
                        parse_grouped_number("loc_text").alias("loc"),
                        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("stars"),
                        F.col("commits").cast("double").alias("commits"),
                        F.col("issues").cast("double").alias("issues"),
                        "start_date",
                        F.bround(years_since("start_date", AS_OF_DATE), 6).alias("age_years")))


def bug_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, <types>..., total) for projects that have bugs."""
    return count_matrix(bugs(spark, sf_dir), "project", "bug_type", TYPE_ORDER, "total")


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bug matrix joined to the project dimension (projects with bugs only:
    a project absent from the facts would only carry NULL counts)."""
    return bug_matrix(spark, sf_dir).join(projects(spark, sf_dir), "project", "inner")
