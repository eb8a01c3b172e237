import numpy as np
import pytest

from faultline.llm import queries as Q, whitening as W
from tests.llm.conftest import SMALL


def whole(v):
    return [int(np.floor(64 * float(np.float64(c)))) + 1_000_000 for c in v]


def brute(rows, k):
    """x, n, S, eigenvalues and unit eigenvectors by numpy."""
    x = np.array([whole(v) for _, v in rows], dtype=object)
    fit = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    c = np.array([[float(n * a - b) for a, b in zip(row, s)] for row in fit]) / n
    value, axes = np.linalg.eigh(c.T @ c / n)
    return x, n, s, value[::-1][:k], axes[:, ::-1][:, :k], value.sum()


def check(found, rows, k, close=1e-9):
    x, n, s, value, axes, trace = brute(rows, k)
    by = {}
    for r in found:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert len(found) == len(rows) * k and all(sorted(v) == list(range(1, k + 1)) for v in by.values())
    off = np.array([[n * a - b for a, b in zip(row, s)] for row in x], dtype=object)
    z = (off.astype(float) / n) @ axes / np.sqrt(value)
    got = np.array([[by[key][j + 1].whitened for j in range(k)] for key, _ in rows])
    assert np.abs(got * np.sign((got * z).sum(axis=0)) - z).max() < close
    for (key, _), o in zip(rows, off):
        r = by[key][1]
        assert (r.n, r.deviation) == (n, sum(d * d for d in o))
        assert abs(r.explained - value[0] / trace) < 1e-9 and r.identity_error < 1e-9


def test_query_against_numpy(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    check(Q.op13_embedding_whitening(spark, SMALL).collect(), rows, 16)


@pytest.mark.parametrize("dim,k", [(1, 1), (5, 5), (60, 4), (200, 16)])
def test_eigenpairs(dim, k):
    rng = np.random.default_rng(dim)
    q = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    value = np.sort(rng.random(dim) ** 3)[::-1] * 50
    value[: min(3, dim)] = 50  # a multiple eigenvalue
    a = (q * value) @ q.T
    a = (a + a.T) / 2
    seen = []
    found, axes, rest = W.eigenpairs(lambda y: seen.append(y.shape[1]) or a @ y, dim, k)
    assert np.abs(found - value[:k]).max() < 1e-12 * 50 and rest.max() < 1e-12 * 50
    assert np.abs(axes.T @ axes - np.eye(k)).max() < 1e-12
    gap = value[k - 1] - (value[k] if k < dim else -1)
    if gap > 1e-3:  # the wanted space, whatever its basis
        p = q[:, :k] @ q[:, :k].T
        assert np.abs(axes @ axes.T - p).max() < 1e-9


def test_a_wide_operator_is_not_filled_up():
    """Wanted eigenpairs that stand apart converge long before the space is whole."""
    dim, rng = 1500, np.random.default_rng(5)
    q = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    value = np.r_[100 * .8 ** np.arange(8), rng.random(dim - 8)]
    a, columns = (q * value) @ q.T, [0]

    def product(y):
        columns[0] += y.shape[1]
        return a @ y
    found, _, rest = W.eigenpairs(product, dim, 8)
    assert np.abs(found - value[:8]).max() < 1e-10 and rest.max() < 1e-10 and columns[0] < dim / 2


def test_minres_solves():
    rng = np.random.default_rng(4)
    a = rng.standard_normal((12, 12))
    a = a + a.T
    b = rng.standard_normal((12, 3))
    b[:, 2] = 0
    assert np.abs(a @ W.minres(lambda y: a @ y, b, 40) - b).max() < 1e-8


def test_edges(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.standard_normal(6) * [9, 5, 3, 2, 1, .5]).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(200)]  # copies
    rows += [(2000, [-900.] * 6), (2001, [3e4, 0., 0., 0., 0., 0.])]  # wider integers
    bad = [(3000, None), (3001, []), (3002, [1.0, None, 1., 1., 1., 1.]), (3003, [float("nan")] * 6), (3004, [float("inf")] * 6), (3005, [1.0] * 7), (3006, [1e300] * 6)]
    table = spark.createDataFrame([(k, v, 1, 2.0, "x") for k, v in rows + bad], "vec_id long, embedding array<double>, component int, whitened double, N string").repartition(7)
    check(W.whiten(table, components=4).collect(), rows, 4, close=1e-6)


def test_deviations_beyond_a_long_are_null(spark):
    table = spark.createDataFrame([(1, [1e15, 0.]), (2, [-1e15, 1.]), (None, [0., 2.]), (3, [5., 3.])], "vec_id long, embedding array<double>")
    found = W.whiten(table).collect()
    assert {r.vec_id for r in found if r.deviation is None} >= {1, 2} and {r.vec_id for r in found} == {1, 2, 3, None}


def test_no_variance_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert W.whiten(spark.createDataFrame(rows, schema)).collect() == []
    # A flat dimension has no component.
    flat = W.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [5.0, 2.0])], schema)).collect()
    assert [(r.component, r.n) for r in flat] == [(1, 2), (1, 2)] and {round(r.whitened, 9) for r in flat} == {1.0, -1.0}


def test_many_partial_sums_meet_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(W, "FAN", 2)
    rows = [(i, [float(i % 17), float(i * i % 23), float(i % 5)]) for i in range(90)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(11)
    check(W.whiten(table, components=3).collect(), rows, 3)
