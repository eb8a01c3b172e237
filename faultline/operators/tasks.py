"""Operators on exported label tasks (S7 shape): the labelled/unlabelled
split, first-choice labels, training and prediction rows, and the per
category prediction summary (F5, F6, F7, F14, M1, M2, A6, A7, A8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators.records import record_text


def _record(tasks_data: Column) -> Column:
    return F.struct(tasks_data["commit"].alias("commit"), tasks_data["pull_requests"].alias("pull_requests"),
                    tasks_data["issues"].alias("issues"), tasks_data["security"].alias("security"))


def first_choice(annotations) -> Column:
    """the first choice of the first annotation result that has choices,
    annotations and results in order; NULL when there is none."""
    a = F.col(annotations) if isinstance(annotations, str) else annotations
    per_annotation = F.transform(F.coalesce(a, F.array()), lambda ann: F.transform(
        F.filter(F.coalesce(ann["result"], F.array()),
                 lambda r: F.coalesce(F.size(r["value"]["choices"]), F.lit(0)) > 0),
        lambda r: F.get(r["value"]["choices"], 0)))
    return F.get(F.flatten(per_annotation), 0)


def is_labelled(annotations) -> Column:
    """a task with at least one annotation."""
    a = F.col(annotations) if isinstance(annotations, str) else annotations
    return F.coalesce(F.size(a), F.lit(0)) > 0


def training_rows(tasks: DataFrame) -> DataFrame:
    """M1: (text, label, id) for labelled tasks with a label and a text."""
    x = tasks.where(is_labelled("annotations")).select(
        "id", record_text(_record(F.col("data"))).alias("text"), first_choice("annotations").alias("label"))
    return x.where(F.col("label").isNotNull() & F.col("text").isNotNull())


def prediction_rows(tasks: DataFrame) -> DataFrame:
    """M2 + J10: (text, id) for unlabelled tasks with a text."""
    x = tasks.where(~is_labelled("annotations")).select(
        "id", record_text(_record(F.col("data"))).alias("text"))
    return x.where(F.col("text").isNotNull())


def category_pairs(tasks: DataFrame, source: str = "predictions") -> DataFrame:
    """A6 long form: one (category, index) row per choice of the first result
    of every prediction (or annotation), in task order; tasks without a
    commit index are skipped (F14)."""
    items = F.filter(F.coalesce(F.col(source), F.array()), lambda p: F.coalesce(F.size(p["result"]), F.lit(0)) > 0)
    firsts = F.transform(items, lambda p: F.coalesce(F.get(p["result"], 0)["value"]["choices"],
                                                     F.array().cast("array<string>")))
    return (tasks.where(F.col("data.commit_index").isNotNull())
                 .select(F.col("data.commit_index").alias("index"), F.explode(F.flatten(firsts)).alias("category")))


def category_counts(pairs: DataFrame) -> DataFrame:
    """Count per category (the index list stays in long form)."""
    return pairs.groupBy("category").agg(F.count(F.lit(1)).alias("count"))


def task_summary(tasks: DataFrame, source: str = "predictions") -> DataFrame:
    """A7 + A8: totals over tasks and the number of distinct categories."""
    has = F.coalesce(F.size(F.col(source)), F.lit(0)) > 0
    totals = tasks.agg(F.count(F.lit(1)).alias("total_tasks"),
                       F.count_if(has).alias("tasks_with_predictions"),
                       F.count_if(~has).alias("tasks_without_predictions"))
    cats = category_pairs(tasks, source).agg(F.count_distinct("category").alias("total_categories"))
    # Both sides are single-row global aggregates: joined on a constant key.
    return (totals.withColumn("_k", F.lit(1))
                  .join(cats.withColumn("_k", F.lit(1)), "_k", "inner").drop("_k"))
