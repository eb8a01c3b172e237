"""Published results recomputed from the two published input tables."""

import os

import pytest
from pyspark.sql import functions as F

from faultline.functions.labels import BUG_ORDER, normalize_key, parse_grouped_number
from faultline.operators import stats as S

from conftest import FIXTURES

ATTRS = ["LOC", "Stars", "Commits", "Issues"]


def _merged(spark):
    counts = spark.read.option("header", True).option("inferSchema", True) \
        .csv(os.path.join(FIXTURES, "published_bug_counts.csv"))
    projects = spark.read.option("header", True).csv(os.path.join(FIXTURES, "published_projects.csv"))
    projects = projects.select(
        normalize_key("Project").alias("project"), F.trim("Domain").alias("Domain"),
        parse_grouped_number(F.col("`Size (LOC)`")).alias("LOC"),
        F.col("Stars").try_cast("double").alias("Stars"),
        F.col("Commits").try_cast("double").alias("Commits"),
        F.col("Issues").try_cast("double").alias("Issues"))
    return counts.join(projects, "project", "inner")


def test_all_projects_match_after_key_normalization(spark):
    assert _merged(spark).count() == 16


def test_spearman_published_values(spark):
    m = _merged(spark)
    out = S.with_p_values(S.spearman_listwise(m, "project", BUG_ORDER, ATTRS))
    got = {(r.row_name, r.col_name): r for r in out.collect()}
    assert len(got) == 44
    assert all(r.n == 15 for r in got.values())  # the project without Stars is dropped listwise
    assert got[("Logic Error", "LOC")].rho == pytest.approx(0.573236854039622, abs=1e-9)
    assert got[("Logic Error", "LOC")].p_value == pytest.approx(0.0254878656127304, abs=1e-6)
    assert got[("Error Handling", "LOC")].rho == pytest.approx(0.539451251793176, abs=1e-9)
    assert got[("Error Handling", "LOC")].p_value == pytest.approx(0.0379511392594645, abs=1e-6)
    assert got[("Logic Error", "Commits")].rho == pytest.approx(0.522921393496959, abs=1e-9)
    assert got[("Logic Error", "Commits")].p_value == pytest.approx(0.0454879074108763, abs=1e-6)
    assert got[("Runtime Exception", "LOC")].rho == pytest.approx(0.0, abs=1e-12)
    assert got[("Runtime Exception", "LOC")].p_value == pytest.approx(1.0, abs=1e-9)
    assert got[("Type Error", "Issues")].rho == pytest.approx(-0.110518853671248, abs=1e-9)
    assert got[("Test Fault", "Stars")].p_value == pytest.approx(0.72408140632469, abs=1e-6)


def test_kruskal_wallis_published_values(spark):
    m = _merged(spark)
    long = S.to_long(m, ["project", "Domain"], BUG_ORDER, "category", "value")
    got = {r.category: r for r in S.kruskal_wallis(long, "category", "Domain", "value").collect()}
    assert got["Test Fault"].df == 7
    assert got["Test Fault"].h == pytest.approx(11.97838, abs=1e-4)
    assert got["Test Fault"].p_value == pytest.approx(0.101272220926647, abs=1e-6)
    assert got["Async / Event"].p_value == pytest.approx(0.20104555988801, abs=1e-6)
    assert got["API Misuse"].p_value == pytest.approx(0.713769966623786, abs=1e-6)
    assert got["Logic Error"].p_value == pytest.approx(0.767919182095786, abs=1e-6)
    assert got["Error Handling"].p_value == pytest.approx(0.655269440308823, abs=1e-6)


def test_published_totals(spark):
    m = _merged(spark)
    row = m.agg(F.sum("Total").alias("t"), F.avg("Total").alias("a")).first()
    assert row.t == 633
    assert round(row.a, 2) == 39.56
