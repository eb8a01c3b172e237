import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultline.functions import stats as ST
from faultline.operators import ranks as RK
from faultline.operators import stats as S


def _pearson_of_ranks(a, b):
    ra, rb = pd.Series(a).rank(), pd.Series(b).rank()
    return float(np.corrcoef(ra, rb)[0, 1])


def test_midranks_match_pandas(spark):
    vals = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, None]
    df = spark.createDataFrame([(i, "k", None if v is None else float(v)) for i, v in enumerate(vals)],
                               "id long, name string, value double")
    out = {r.id: r.rank for r in RK.midranks(df, ["name"], "value", buckets=4).collect()}
    expected = pd.Series(vals, dtype="float").rank()
    for i, v in enumerate(vals):
        if v is None:
            assert out[i] is None
        else:
            assert out[i] == pytest.approx(expected[i])


def test_positions_and_global_positions(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(50)], "id long, g long")
    pos = RK.positions(df, ["g"], ["id"], "p", partitions=4).collect()
    by_g = {}
    for r in pos:
        by_g.setdefault(r.g, []).append(r.p)
    for g, ps in by_g.items():
        assert sorted(ps) == list(range(len(ps)))
    gp = RK.global_positions(df, [F.col("g").asc(), F.col("id").desc()], "pos", partitions=4).collect()
    ordered = sorted(gp, key=lambda r: r.pos)
    assert [r.pos for r in ordered] == list(range(1, 51))
    assert [(r.g, r.id) for r in ordered] == sorted([(r.g, r.id) for r in gp], key=lambda t: (t[0], -t[1]))


def test_spearman_listwise_and_pairwise(spark):
    rows = [(1, 1.0, 2.0, 5.0), (2, 2.0, 2.0, None), (3, 3.0, 1.0, 4.0), (4, 4.0, 7.0, 3.0),
            (5, 5.0, 3.0, 2.0), (6, 6.0, 3.0, 1.0)]
    df = spark.createDataFrame(rows, "u long, a double, b double, c double")
    lw = {(r.row_name, r.col_name): r for r in S.spearman_listwise(df, "u", ["a", "b", "c"]).collect()}
    comp = [r for r in rows if None not in r]
    assert lw[("b", "a")].n == 5
    assert lw[("b", "a")].rho == pytest.approx(_pearson_of_ranks([r[1] for r in comp], [r[2] for r in comp]))
    pw = {(r.row_name, r.col_name): r for r in S.spearman_pairwise(df, "u", ["a", "b", "c"]).collect()}
    assert pw[("b", "a")].n == 6
    assert pw[("b", "a")].rho == pytest.approx(_pearson_of_ranks([r[1] for r in rows], [r[2] for r in rows]))
    assert pw[("c", "a")].rho == pytest.approx(-1.0)


def test_spearman_constant_column_is_null(spark):
    df = spark.createDataFrame([(i, float(i), 1.0) for i in range(6)], "u long, a double, b double")
    out = S.spearman_pairwise(df, "u", ["a", "b"]).first()
    assert out.rho is None


def test_p_values_known():
    # chi-square upper tail: df=1 at 3.841459 ~ 0.05; df=4 closed form
    assert ST.chi2_upper(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    x = 7.3
    assert ST.chi2_upper(x, 4) == pytest.approx(math.exp(-x / 2) * (1 + x / 2), rel=1e-12)
    # t test of r: n=15, r=0.573236854 -> p 0.025487866 (published golden)
    assert ST.corr_p_value(0.573236854039622, 15) == pytest.approx(0.0254878656127304, abs=1e-9)
    assert ST.corr_p_value(1.0, 10) == 0.0
    assert math.isnan(ST.corr_p_value(0.5, 4))


def test_jvm_tails_match_reference(spark):
    df = spark.createDataFrame([(7.3, 4), (2.0, 2), (11.0, 6), (3.0, 3), (11.97838, 7), (0.0, 3), (250.0, 9)],
                               "x double, df int")
    for r in df.select("x", "df", ST.chi2_upper_jvm("x", "df").alias("p")).collect():
        assert r.p == pytest.approx(ST.chi2_upper(r.x, r.df), abs=1e-12)
    cases = [(0.573236854039622, 15), (0.0, 15), (-0.3, 150), (0.999, 40), (0.01, 15000000), (1.0, 10),
             (0.5, 4), (None, 20)]
    df = spark.createDataFrame(cases, "r double, n long")
    for r in df.select("r", "n", ST.corr_p_value_col("r", "n").alias("p")).collect():
        if r.r is None or r.n < 5:
            assert r.p is None
        else:
            assert r.p == pytest.approx(ST.corr_p_value(r.r, r.n), abs=1e-11)


def test_lgamma(spark):
    from pyspark.sql import functions as F
    xs = [0.5, 1.0, 2.5, 10.0, 7.5e6]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(ST.lgamma_col("x").alias("l")).collect()
    for x, r in zip(xs, got):
        assert r.l == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-12)


def test_kruskal_wallis_hand_computed(spark):
    groups = {"g1": [1.0, 2.0, 2.0], "g2": [3.0, 4.0], "g3": [2.0, 5.0, 6.0, 6.0]}
    rows = [("c", g, v) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "name string, grp string, value double")
    out = S.kruskal_wallis(df, "name", "grp", "value").first()
    allv = pd.Series([v for vs in groups.values() for v in vs])
    ranks = allv.rank()
    n = len(allv)
    idx = 0
    q = 0.0
    for vs in groups.values():
        r = ranks[idx: idx + len(vs)].sum()
        q += r * r / len(vs)
        idx += len(vs)
    h = 12 / (n * (n + 1)) * q - 3 * (n + 1)
    ties = sum(t ** 3 - t for t in allv.value_counts())
    h /= 1 - ties / (n ** 3 - n)
    assert out.h == pytest.approx(h)
    assert out.df == 2
    assert out.p_value == pytest.approx(math.exp(-h / 2))


def test_medians_zscores_distance(spark):
    df = spark.createDataFrame([("d1", 1.0, 1.0), ("d1", 3.0, None), ("d2", 5.0, 2.0)],
                               "domain string, a double, b double")
    med = {r.domain: r for r in S.medians_all_present(df, "domain", ["a", "b"]).collect()}
    assert med["d1"].a == 2.0 and med["d1"].b is None and med["d2"].b == 2.0
    long = spark.createDataFrame([("d1", "a", 1.0), ("d2", "a", 3.0), ("d1", "b", 2.0), ("d2", "b", 2.0)],
                                 "domain string, category string, median double")
    z = {(r.domain, r.category): r.z for r in S.zscores(long, "category", "median").collect()}
    assert z[("d1", "a")] == pytest.approx(-1 / math.sqrt(2))
    assert z[("d1", "b")] is None
    d = S.profile_distance(S.zscores(long, "category", "median"), "domain", "category", "z", 2).first()
    # one usable coordinate out of two -> scaled by 2
    assert d.distance == pytest.approx(math.sqrt((2 / math.sqrt(2)) ** 2 * 2))


def test_exact_median_matches_pandas(spark):
    import random
    rnd = random.Random(7)
    rows = []
    for g, n in (("a", 1), ("b", 2), ("c", 7), ("d", 40), ("e", 41)):
        for i in range(n):
            rows.append((g, float(rnd.choice([1, 2, 2, 3, 5, 8, 8, 8, 13]))))
    rows.append(("d", None))
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.median for r in RK.exact_median(df, ["g"], "v", buckets=4).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    for g, m in pdf.groupby("g")["v"].median().items():
        assert got[g] == pytest.approx(m)


@pytest.mark.parametrize("h,df,want", [(3_999_000.0, 4_000_000.0, 0.6381), (39_990_000.0, 40_000_000.0, 0.8682), (40_020_000.0, 40_000_000.0, 0.0127)])
def test_chi2_tail_converges_for_large_df(spark, h, df, want):
    """Checked against the normal limit of the cube root (Wilson and Hilferty)."""
    import math
    from faultline.functions.stats import chi2_upper_jvm
    z = ((h / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    got = spark.createDataFrame([(h, df)], "h double, df double").select(chi2_upper_jvm("h", "df").alias("p")).first().p
    assert got == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), abs=2e-4) and got == pytest.approx(want, abs=3e-4)


def test_contrastive_pairs_two_classes_and_rare_ones(spark):
    from faultline.operators.classify import contrastive_pairs
    rows = [(i, "a" if i < 10 else "b") for i in range(20)]
    label = dict(rows)
    out = contrastive_pairs(spark.createDataFrame(rows, "id long, l string"), "id", "l", 2).collect()
    assert sum(r.target for r in out) == 40 and len(out) == 80
    assert all(r.a_id != r.b_id and (label[r.a_id] == label[r.b_id]) == bool(r.target) for r in out)
    rows = [(i, "rare" if i < 2 else "c" if i < 3 else "big") for i in range(300)]
    label = dict(rows)
    out = contrastive_pairs(spark.createDataFrame(rows, "id long, l string"), "id", "l", 10).collect()
    assert all(r.a_id != r.b_id and (label[r.a_id] == label[r.b_id]) == bool(r.target) for r in out)
    assert sum(1 - r.target for r in out) == 3000 and sum(r.target for r in out) == 2990


def test_absent_cells_are_filled_and_undefined_ones_stay(spark):
    from faultline.operators.counts import pivot_wide
    long = spark.createDataFrame([("d", "x", None), ("d", "y", 2.0), ("e", "x", 1.0)], "d string, c string, z double")
    got = {r.d: (r.x, r.y) for r in pivot_wide(long, ["d"], "c", "z", ["x", "y"], 0.0).collect()}
    assert got == {"d": (None, 2.0), "e": (1.0, 0.0)}
