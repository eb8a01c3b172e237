"""Pairs by number (M4), the pair-trained projection (M3), class measures (M7)."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators import classify as M
from faultline.operators import projection as P
from faultline.operators import verify as V


@pytest.mark.parametrize("sizes,n", [((5, 3, 1), None), ((4,), None), ((1, 1, 1), 7), ((30, 2, 2, 9), 50), ((6, 6), 10_000)])
def test_oversampled_pairs(spark, sizes, n):
    label, rows = {}, []
    for c, size in enumerate(sizes):
        for _ in range(size):
            label[len(rows) * 3] = f"c{c}"
            rows.append((len(rows) * 3, f"c{c}"))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows + [(999, None)], "id long, label string").repartition(4)
    got = M.oversampled_pairs(df, "id", "label", n).collect()
    kinds = {1: {(a, b) for a in label for b in label if a < b and label[a] == label[b]}, 0: {(a, b) for a in label for b in label if a < b and label[a] != label[b]}}
    wanted = n if n is not None else max(map(len, kinds.values()))
    for target, every in kinds.items():
        mine = [(r.a_id, r.b_id) for r in got if r.target == target]
        assert len(mine) == (wanted if every else 0) and set(mine) <= every
        if every:  # spread evenly: a pair is drawn as often as any other, give or take one
            often = [mine.count(x) for x in every] if len(mine) < 2000 else []
            assert not often or max(often) - min(often) <= 1
    assert len({(r.k, r.target) for r in got}) == len(got)


def test_pair_numbers_of_large_classes(spark):
    """The triangle root is exact where doubles round."""
    n = 3_000_000_000
    r = [0, 1, 2, n * (n - 1) // 2 - 1, (n - 1) * (n - 2) // 2, (n - 1) * (n - 2) // 2 - 1, 2 ** 53 + 1]
    x = spark.createDataFrame([(v,) for v in r], "r long")
    guess = F.floor((1 + F.sqrt(8.0 * F.col("r") + 1)) / 2).cast("long")
    x = x.withColumn("j", guess).withColumn("j", F.when(F.expr("j * (j - 1) div 2 > r"), F.col("j") - 1).when(F.expr("j * (j + 1) div 2 <= r"), F.col("j") + 1).otherwise(F.col("j")))
    for row in x.collect():
        assert row.j * (row.j - 1) // 2 <= row.r < row.j * (row.j + 1) // 2


def planted(seed, n, classes=4, noise=20):
    """Class directions in a few coordinates, noise in the others, and lengths that vary by row."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        length = rng.lognormvariate(0, 1.5)
        rows.append((i, i % classes, [length * rng.gauss(1.5 if j == i % classes else 0, .5) for j in range(classes)] + [length * rng.gauss(0, 1) for _ in range(noise)]))
    return rows


def test_projection_learns_and_beats_the_plain_head(spark):
    df = spark.createDataFrame(planted(3, 800), "vec_id long, label int, embedding array<double>")
    train, rest = df.where("vec_id < 400"), df.where("vec_id >= 400")  # no fitted row is predicted
    pairs = P.pair_vectors(M.contrastive_pairs(train.select("vec_id", "label"), "vec_id", "label"), train, "vec_id", "embedding")
    matrix, losses = P.fit_projection(pairs, rounds=12)
    assert all(b < a for a, b in zip(losses, losses[1:])) and losses[-1] < .6 * losses[0]

    def accuracy(features):
        model = M.embedding_classifier("label").fit(features(train))
        out = M.predictions(model.transform(features(rest))).collect()
        assert len(out) == 400
        return sum(r.label == r.predicted for r in out) / 400
    plain, learned = accuracy(M.with_features), accuracy(lambda x: P.project(x, matrix))
    assert learned > plain + .02, (plain, learned)


def test_projection_gradient(spark):
    rng = np.random.default_rng(2)
    a, b, t, w = rng.standard_normal((7, 4)), rng.standard_normal((7, 4)), np.array([1, 0, 1, 0, 1, 0, 1.]), rng.standard_normal((4, 3))
    a[6] = 0
    _, du, dv = P._losses(w, a, b, t)
    g, h = a.T @ du + b.T @ dv, 1e-6
    for i in range(4):
        for j in range(3):
            e = np.zeros_like(w)
            e[i, j] = h
            assert abs((P._losses(w + e, a, b, t)[0].sum() - P._losses(w - e, a, b, t)[0].sum()) / (2 * h) - g[i, j]) < 1e-6


def test_projection_edges(spark, monkeypatch):
    monkeypatch.setattr(P, "FAN", 2)
    vectors = spark.createDataFrame([(i, [float(i), 1.0, -float(i % 3)]) for i in range(9)] + [(9, None)], "id long, v array<double>")
    pairs = spark.createDataFrame([(i, (i + 3) % 10, 1) for i in range(10)] + [(i, (i + 1) % 10, 0) for i in range(10)], "a_id long, b_id long, target int").repartition(7)
    matrix, losses = P.fit_projection(P.pair_vectors(pairs, vectors, "id", "v"), rounds=3, rank=2)
    assert matrix.shape == (3, 2) and losses == sorted(losses, reverse=True)
    got = {r.id: r.features for r in P.project(vectors, matrix, "v").collect()}
    assert got[9] is None and np.allclose(got[5].toArray(), np.array([5.0, 1.0, -2.0]) @ matrix)
    with pytest.raises(ValueError):
        P.fit_projection(P.pair_vectors(pairs.where("false"), vectors, "id", "v"))


def test_class_measures_with_ties(spark):
    rng = random.Random(8)
    names = ["a", "b", "c"]
    rows = []
    for i in range(300):
        p = [rng.choice([.1, .2, .4, .40049]) for _ in names]
        rows.append((rng.choice(names + [None]), {k: x for k, x in zip(names, p)} if i % 50 else None))
    df = spark.createDataFrame(rows, "gold string, class_probs map<string,double>")
    whole = V.score_histogram(df, names)
    got = {r["class"]: r for r in V.class_measures(whole).collect()}
    kept = [(g, p) for g, p in rows if g and p]
    for c in names:
        top = [max(names, key=lambda k: (p[k], -names.index(k))) for _, p in kept]
        y, s, hit = [g == c for g, _ in kept], [int(p[c] * 1000) for _, p in kept], [t == c for t in top]
        tp, chosen, pos = sum(a and b for a, b in zip(y, hit)), sum(hit), sum(y)
        area = sum((1 if u > v else .5 if u == v else 0) for u, a in zip(s, y) if a for v, b in zip(s, y) if not b) / (pos * (len(y) - pos))
        r = got[c]
        assert (r.n, r.n_class, r.n_correct, r.n_predicted) == (len(kept), pos, tp, chosen)
        assert abs(r.precision - tp / chosen) < 1e-6 and abs(r.recall - tp / pos) < 1e-6 and abs(r.roc_area - area) < 1e-6
        assert abs(r.f1 - 2 * tp / (chosen + pos)) < 1e-6 and 0 <= r.calibration_error <= 1
    # Histograms of parts add up.
    sums = [F.sum(c).alias(c) for c in whole.columns[2:]]
    parts = V.score_histogram(df.limit(100), names).unionByName(V.score_histogram(df.offset(100), names)).groupBy("class", "bin").agg(*sums)
    assert sorted(map(tuple, V.class_measures(parts).collect())) == sorted(map(tuple, V.class_measures(whole).collect()))
    assert V.class_measures(V.score_histogram(df.where("false"), names)).collect() == []
