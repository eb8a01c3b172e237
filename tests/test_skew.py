"""Skewed input: one key holds a third of all rows. The skew-safe operators
must stay exact (checked against pandas by brute force)."""

import random

import pandas as pd
import pytest

from faultline.operators import ranks as RK


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(11)
    rows = [(i, "hot", float(rnd.choice([1, 2, 2, 3, 3, 3, 5, 8]))) for i in range(1500)]
    rows += [(1500 + i, f"k{i % 40}", float(rnd.randint(0, 50))) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "id long, key string, v double")


def test_midranks_under_skew(spark, skewed):
    rows, df = skewed
    got = {r.id: r["rank"] for r in RK.midranks(df, ["key"], "v", buckets=6).collect()}
    pdf = pd.DataFrame(rows, columns=["id", "key", "v"])
    pdf["rank"] = pdf.groupby("key")["v"].rank(method="average")
    for i, r in zip(pdf["id"], pdf["rank"]):
        assert got[i] == pytest.approx(r)


def test_exact_median_under_skew(spark, skewed):
    rows, df = skewed
    got = {r.key: r.median for r in RK.exact_median(df, ["key"], "v", buckets=6).collect()}
    pdf = pd.DataFrame(rows, columns=["id", "key", "v"])
    for k, m in pdf.groupby("key")["v"].median().items():
        assert got[k] == pytest.approx(m)


def test_positions_under_skew(spark, skewed):
    _, df = skewed
    pos = RK.positions(df, ["key"], ["id"], "p", partitions=8).collect()
    by_key = {}
    for r in pos:
        by_key.setdefault(r.key, []).append(r.p)
    for ps in by_key.values():
        assert sorted(ps) == list(range(len(ps)))
    assert len(by_key["hot"]) == 1500
