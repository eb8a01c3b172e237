"""Plan-shape checks that guard the scale design of every registered query."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries

from conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_cartesian_or_nested_loop_join(spark, name):
    plan = _plan(queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_top_n_limit_runs_before_the_shuffle(spark):
    plan = _plan(queries()["time_window_limit"](spark, SF_SMALL))
    lines = plan.split("\n")
    limit_rows = [i for i, l in enumerate(lines) if "WindowGroupLimit" in l]
    exchange_rows = [i for i, l in enumerate(lines) if "Exchange hashpartitioning(user_id" in l]
    assert limit_rows and exchange_rows and max(limit_rows) > min(exchange_rows)


def test_scans_are_pruned_and_filtered(spark):
    df = queries()["time_window_limit"](spark, SF_SMALL)
    plan = _plan(df)
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in plan
    assert "GreaterThanOrEqual(ts," in plan
    plan = _plan(queries()["type_counts"](spark, SF_SMALL))
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in plan


def test_partial_aggregation_before_shuffle(spark):
    plan = _plan(queries()["token_counts"](spark, SF_SMALL))
    assert plan.count("HashAggregate") >= 2


def test_heavy_cleaning_evaluated_once(spark):
    plan = _plan(queries()["train_set"](spark, SF_SMALL))
    assert plan.count("regexp_extract_all") == 2   # message and description, once each


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_positions_are_exact_with_a_payload(spark, scratch, reuse):
    """Columns outside the order must not change the ranges that counts and rows see."""
    from faultline.operators.ranks import global_positions, positions
    n = 300_000
    spark.range(n).select(F.col("id"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("v"), (F.col("id") % 3).alias("k"),
                          F.concat(F.lit("payload "), F.col("id").cast("string")).alias("payload")) \
         .repartition(6).write.parquet(f"{scratch}/rows")
    df = spark.read.parquet(f"{scratch}/rows")
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        g = global_positions(df, [F.col("v").desc(), F.col("id").asc()], "pos", partitions=5)
        assert g.agg(F.count_distinct("pos"), F.min("pos"), F.max("pos")).first() == (n, 1, n)
        p = positions(df, ["k"], ["v", "id"], "pos", partitions=5).groupBy("k").agg(F.count_distinct("pos").alias("d"), F.max("pos").alias("m"))
        assert sorted(map(tuple, p.collect())) == [(i, n // 3, n // 3 - 1) for i in range(3)]
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")


def test_links_are_extracted_once_a_use(spark):
    plan = _plan(queries()["label_set_ops"](spark, SF_SMALL))
    assert plan.split("Initial Plan")[-1].count("FileScan parquet") <= 2


def test_ranks_consistent_without_exchange_reuse(spark):
    from faultline.operators.ranks import midranks
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        df = spark.createDataFrame([(i, "k", float(i % 37)) for i in range(2000)], "id long, name string, value double")
        ranks = sorted(r["rank"] for r in midranks(df, ["name"], "value", buckets=5).collect())
        assert abs(sum(ranks) - 2000 * 2001 / 2) < 1e-6
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")
