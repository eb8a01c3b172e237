"""Sinks (K1-K10). All writers are distributed DataFrame writes; nothing is
collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.urls import url_groups


def write_commit_records(records: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """K1: combined commit records, partitioned by repository. The record key
    is a column (``commit_index``), not a file name; empty lists are NULL."""
    owner, repo, _ = url_groups("commit_url")
    out = records
    for c in ("pull_requests", "issues", "security"):
        if c in records.columns:
            out = out.withColumn(c, F.when(F.size(c) > 0, F.col(c)))
    # Ranges of (repo, commit): a repository's rows are together, and a large one is in several tasks.
    out = out.withColumn("repo", F.concat_ws("_", owner, repo)).repartitionByRange("repo", "commit_index")
    out.write.mode(mode).partitionBy("repo").format(fmt).save(path)


def write_url_list(accepted: DataFrame, path: str, repo_col: str = "repo", url_col: str = "url") -> None:
    """K2: accepted commit URLs in long form, a (repository, url) row each,
    sorted by repository and URL. No access token is written."""
    (accepted.select(repo_col, url_col).repartitionByRange(repo_col, url_col).sortWithinPartitions(repo_col, url_col)
             .write.mode("overwrite").json(path))


def write_prediction_summary(pred: DataFrame, path: str, key: str, cat: str) -> None:
    """K3: the ``{summary, categories}`` export in long form, written
    distributed: the summary as one JSON row, the count of each category, and
    the (category, index) pairs as JSON lines sorted by category and index. A
    large category is in several tasks. ``readers.read_summary_rows`` reads it."""
    summary = pred.agg(F.count(F.lit(1)).alias("total_tasks"),
                       F.count_if(F.col(cat).isNotNull()).alias("tasks_with_predictions"),
                       F.count_if(F.col(cat).isNull()).alias("tasks_without_predictions"),
                       F.count_distinct(cat).alias("total_categories"))
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    pairs = (pred.where(F.col(cat).isNotNull() & F.col(key).isNotNull())
                 .select(F.col(cat).alias("category"), F.col(key).cast("string").alias("index")))
    pairs.groupBy("category").agg(F.count(F.lit(1)).alias("count")).write.mode("overwrite").json(f"{path}/counts")
    (pairs.repartitionByRange("category", "index").sortWithinPartitions("category", "index")
          .write.mode("overwrite").json(f"{path}/categories"))


def write_verification(verified: DataFrame, path: str, gold_col: str = "gold", key: str = "index") -> None:
    """K4: correct and wrong predictions as two CSV outputs, sorted by gold
    category then key."""
    for name, cond in (("correct", F.col("is_correct")), ("wrong", ~F.col("is_correct"))):
        (verified.where(cond).orderBy(gold_col, key)
                 .write.mode("overwrite").option("header", True).csv(f"{path}/{name}"))


def write_matrix_csv(long: DataFrame, path: str, row: str, col: str, value: str, cols: list[str]) -> None:
    """K5: long result pivoted to a matrix and written as CSV with row names."""
    wide = long.groupBy(row).pivot(col, cols).agg(F.first(value))
    wide.orderBy(row).write.mode("overwrite").option("header", True).csv(path)


def write_prediction_report(pred: DataFrame, path: str, key: str = "id") -> None:
    """K6: one text block per prediction: id, label, confidence, all probs."""
    probs = F.array_join(F.transform(F.map_entries("class_probs"),
                                     lambda e: F.format_string("%s: %.4f", e["key"], e["value"])), ", ")
    text = F.format_string("id: %s\nlabel: %s\nconfidence: %.3f\nprobabilities: %s\n",
                           F.col(key).cast("string"), F.col("predicted").cast("string"),
                           F.col("confidence"), probs)
    pred.select(text.alias("value")).write.mode("overwrite").text(path)


def append_predictions(pred: DataFrame, path: str, model_version: str) -> None:
    """K7: append predictions under a model version (partition column). Plain append:
    a job that runs again doubles its rows; ``manifest.write_predictions`` does not."""
    (pred.withColumn("model_version", F.lit(model_version))
         .write.mode("append").partitionBy("model_version").parquet(path))


def split_quarantine(df: DataFrame, valid) -> tuple[DataFrame, DataFrame]:
    """K9: (good, quarantined) by a validity predicate; NULL counts as invalid."""
    ok = F.coalesce(valid, F.lit(False))
    return df.where(ok), df.where(~ok)


def format_rows(df: DataFrame, cols: list[str], sep: str = " & ") -> DataFrame:
    """Matrix rows as ``a & b & ...`` text lines."""
    return df.select(F.concat_ws(sep, *[F.col(f"`{c}`").cast("string") for c in cols]).alias("value"))
