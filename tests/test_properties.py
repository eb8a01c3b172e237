"""Property tests (hypothesis, few examples: each runs Spark jobs)."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from faultline.operators import stats as S

VALUES = st.lists(st.tuples(st.integers(0, 6), st.integers(-3, 3)), min_size=5, max_size=25)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=VALUES)
def test_spearman_invariant_under_monotone_maps(spark, rows):
    base = [(i, float(a), float(b), math.exp(a), float(b) ** 3) for i, (a, b) in enumerate(rows)]
    df = spark.createDataFrame(base, "u long, a double, b double, ea double, b3 double")
    one = S.spearman_pairwise(df, "u", ["a", "b"], reuse=False).first()
    two = S.spearman_pairwise(df, "u", ["ea", "b3"], reuse=False).first()
    if one.rho is None:
        assert two.rho is None
    else:
        assert two.rho == pytest.approx(one.rho, abs=1e-9)
        assert -1.0 - 1e-12 <= one.rho <= 1.0 + 1e-12


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=VALUES)
def test_spearman_symmetric_and_listwise_equals_pairwise_without_nulls(spark, rows):
    base = [(i, float(a), float(b)) for i, (a, b) in enumerate(rows)]
    df = spark.createDataFrame(base, "u long, a double, b double")
    ab = S.spearman_pairwise(df, "u", ["a"], ["b"], reuse=False).first()
    ba = S.spearman_pairwise(df, "u", ["b"], ["a"], reuse=False).first()
    lw = S.spearman_listwise(df, "u", ["a"], ["b"], reuse=False).first()
    for other in (ba, lw):
        if ab.rho is None:
            assert other.rho is None
        else:
            assert other.rho == pytest.approx(ab.rho, abs=1e-9)
    assert ab.n == ba.n == lw.n == len(rows)
