"""Every registered query against its DuckDB oracle on the smallest tables
(the driver repeats this at sf0.01), plus properties of the results."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry
from faultline.plans.registry import oracle_sql, queries
from faultline.sources.tables import TABLES

from conftest import SF_SMALL

RANDOMIZED = {"classify_embeddings"}
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v + 0.0, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle_or_is_listed():
    missing = set(queries()) - set(oracle_sql())
    assert missing <= {"classify_embeddings", "classify_tasks"}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    otypes = dict(zip(ocols, [str(t) for t in res.description and duck.sql(
        f"SELECT * FROM ({oracle_sql()[name]}) q LIMIT 0").types]))
    for col, t in df.dtypes:
        assert TYPES.get(t, t) == otypes[col], (col, t, otypes[col])
    assert _canon(rows, df.columns) == _canon(res.fetchall(), ocols)


def test_entry_runs(spark):
    assert entry(spark).count() > 0


def test_shares_sum_to_one(spark):
    s = queries()["type_share"](spark, SF_SMALL).groupBy("project").agg(F.sum("share").alias("s"))
    assert all(abs(r.s - 1.0) < 1e-5 for r in s.collect())


def test_rho_bounded_and_pvalues_present(spark):
    rows = queries()["spearman_pvalues"](spark, SF_SMALL).collect()
    assert rows
    for r in rows:
        assert r.rho is None or -1.0 <= r.rho <= 1.0
        assert r.p_value is None or 0.0 <= r.p_value <= 1.0


def test_correct_plus_wrong_equals_joined(spark):
    v = queries()["verify_predictions"](spark, SF_SMALL)
    c = queries()["confusion_counts"](spark, SF_SMALL)
    assert c.agg(F.sum("n")).first()[0] == v.count()


def test_pivot_then_unpivot_is_identity(spark):
    long = queries()["matrix_long"](spark, SF_SMALL).where(F.col("n") > 0)
    counts = queries()["type_counts"](spark, SF_SMALL)
    assert sorted(tuple(r) for r in long.collect()) == sorted(tuple(r) for r in counts.collect())


def test_classifier_outputs(spark):
    """The given labels cannot be learned from the given vectors: rows and confidences only."""
    out = queries()["classify_embeddings"](spark, SF_SMALL).collect()
    assert len(out) == spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").count()
    assert all(0.0 < r.confidence <= 1.0 for r in out)


def test_classifier_learns_planted_classes(spark):
    """Held-out accuracy on classes that can be told apart; no fitted row is predicted."""
    import random

    from faultline.operators import classify as M
    rng = random.Random(4)
    rows = [(i, i % 5, [rng.gauss(3.0 if j == i % 5 else 0.0, 1.0) for j in range(8)]) for i in range(400)]
    df = M.with_features(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    model = M.embedding_classifier("label").fit(df.where("vec_id < 200"))
    out = M.predictions(model.transform(df.where("vec_id >= 200"))).collect()
    assert len(out) == 200 and sum(r.label == r.predicted for r in out) / 200 > 0.8


def test_task_classifier_labels_every_unlabelled_task(spark):
    out = queries()["classify_tasks"](spark, SF_SMALL)
    rows = out.collect()
    assert len(rows) == queries()["predict_set"](spark, SF_SMALL).count()
    assert {r.predicted_label for r in rows} <= {"quality_0", "quality_1"}
    assert all(0.0 < r.confidence <= 1.0 for r in rows)


def test_model_save_and_load(spark, scratch):
    from faultline.operators import classify as M
    train = queries()["train_set"](spark, SF_SMALL)
    model, classes = M.fit_text_classifier(train, "text", "label", num_features=1 << 12)
    assert classes == sorted(classes)
    M.save_model(model, f"{scratch}/model")
    again = M.load_pipeline(f"{scratch}/model")
    a = [r.prediction for r in model.transform(train).orderBy("doc_id").collect()]
    b = [r.prediction for r in again.transform(train).orderBy("doc_id").collect()]
    assert a == b
