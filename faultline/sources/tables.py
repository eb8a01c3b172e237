"""Parquet table scans (driver tables) and the stand-in views built on them.

Scans select only the columns a query uses, so Parquet column pruning and
filter pushdown reach the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Give CPU-heavy per-row work (token cleaning, HTML extraction) at least
    one task per core. A large scan already has more splits than cores and
    is returned unchanged; a scan of a few unsplittable files is
    round-robin repartitioned (deterministic on retry: rows are sorted before
    the round robin). Apply it directly on a projected scan: reading the
    split count of a scan only lists files, while on a plan with shuffles it
    would run them."""
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target)


def pinned(expensive):
    """Keep an expensive column where it is computed (after ``spread``).

    Catalyst pushes a filter on a derived column below a repartition by
    copying the column's expression into the filter, which would run the
    work twice, the first time before the rows are spread. Guarding the
    value with a non-foldable, nondeterministic test (always true) stops that
    push; the value is unchanged."""
    return F.when(F.spark_partition_id() >= 0, expensive)
