import json
import os

from pyspark.sql import functions as F

from faultline.operators import classify as M
from faultline.operators.links import two_hop
from faultline.sources import readers as RD
from faultline.sources import sinks as K


def test_two_hop_follows_landed_pages(spark):
    nodes = spark.createDataFrame([(1, "u/commit"), (2, "u/pull/1"), (3, "u/issues/9")], "page_id long, url string")
    edges = spark.createDataFrame([("u/commit", "u/pull/1"), ("u/commit", "u/issues/7"),
                                   ("u/pull/1", "u/issues/9"), ("u/pull/1", "u/commit"),
                                   ("u/pull/1", "u/issues/7")], "src string, dst string")
    out = sorted(tuple(r) for r in two_hop(edges, nodes).collect())
    assert (1, "u/issues/9", 2) in out          # reached through the PR page
    assert (1, "u/issues/7", 1) in out          # hop 1 wins over hop 2
    assert (1, "u/commit", 2) not in out        # no link back to itself
    only_issues = two_hop(edges, nodes, second_hop_filter=lambda d: d.contains("/issues/"))
    assert all("/issues/" in r.dst or r.hop == 1 for r in only_issues.collect())


def test_contrastive_pairs_properties(spark):
    rows = [(i, i % 3) for i in range(20)] + [(100, 7)]
    df = spark.createDataFrame(rows, "id long, label long")
    pairs = M.contrastive_pairs(df, "id", "label", iterations=2).collect()
    label = dict(rows)
    for p in pairs:
        if p.target == 1:
            assert label[p.a_id] == label[p.b_id] and p.a_id != p.b_id
        else:
            assert label[p.a_id] != label[p.b_id]
    # every example of a label with >1 member gets 2 positives; every example gets 2 negatives
    pos = [p for p in pairs if p.target == 1]
    assert len(pos) == 2 * 20
    assert len([p for p in pairs if p.target == 0]) == 2 * 21


def test_sinks(spark, scratch):
    pred = spark.createDataFrame([("a1", "UI Bug"), ("b2", "UI Bug"), ("c3", None), ("d4", "Logic Error")],
                                 "index string, category string")
    K.write_prediction_summary(pred, os.path.join(scratch, "summary"), "index", "category")
    s = spark.read.json(os.path.join(scratch, "summary", "summary")).first()
    assert (s.total_tasks, s.tasks_with_predictions, s.tasks_without_predictions, s.total_categories) == (4, 3, 1, 2)
    cats = spark.read.json(os.path.join(scratch, "summary", "categories"))
    assert sorted((r["category"], r["index"]) for r in cats.collect()) == [("Logic Error", "d4"), ("UI Bug", "a1"),
                                                                      ("UI Bug", "b2")]
    rows, counts = RD.read_summary_rows(spark, os.path.join(scratch, "summary"))
    assert sorted(map(tuple, rows.collect())) == [("Logic Error", "d4"), ("UI Bug", "a1"), ("UI Bug", "b2")]
    assert sorted(map(tuple, counts.collect())) == [("Logic Error", 1), ("UI Bug", 2)]
    ver = spark.createDataFrame([("a1", "UI Bug", "UI Bug", True), ("b2", "API Misuse", "UI Bug", False)],
                                "index string, gold string, predicted string, is_correct boolean")
    K.write_verification(ver, os.path.join(scratch, "ver"))
    assert spark.read.option("header", True).csv(os.path.join(scratch, "ver", "wrong")).count() == 1
    long = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 3.0)], "r string, c string, v double")
    K.write_matrix_csv(long, os.path.join(scratch, "m"), "r", "c", "v", ["x", "y"])
    m = spark.read.option("header", True).csv(os.path.join(scratch, "m")).orderBy("r").collect()
    assert [tuple(x) for x in m] == [("a", "1.0", "2.0"), ("b", "3.0", None)]
    preds = spark.createDataFrame([(1, 2, 0.9, {"2": 0.9, "1": 0.1})],
                                  "id long, predicted int, confidence double, class_probs map<string,double>")
    K.write_prediction_report(preds, os.path.join(scratch, "rep"))
    text = "\n".join(r.value for r in spark.read.text(os.path.join(scratch, "rep")).collect())
    assert "confidence: 0.900" in text and "label: 2" in text
    K.append_predictions(preds.drop("class_probs"), os.path.join(scratch, "app"), "v1")
    K.append_predictions(preds.drop("class_probs"), os.path.join(scratch, "app"), "v2")
    assert spark.read.parquet(os.path.join(scratch, "app")).select("model_version").distinct().count() == 2
    good, bad = K.split_quarantine(long, F.col("v") > 1.5)
    assert good.count() == 2 and bad.count() == 1
    assert [r.value for r in K.format_rows(long.orderBy("r", "c"), ["r", "c", "v"]).collect()][0] == "a & x & 1.0"
    urls = spark.createDataFrame([("o_r", "u2"), ("o_r", "u1")], "repo string, url string")
    K.write_url_list(urls, os.path.join(scratch, "urls"))
    assert sorted((r.repo, r.url) for r in spark.read.json(os.path.join(scratch, "urls")).collect()) == [("o_r", "u1"), ("o_r", "u2")]


def test_csv_and_listing_readers(spark, scratch):
    p = os.path.join(scratch, "projects.csv")
    with open(p, "w") as f:
        f.write('Project,Size (LOC),Start Date\nnest,"82,983",2017-02-04\n')
    df = RD.read_csv_table(spark, p)
    assert df.columns == ["Project", "Size..LOC.", "Start.Date"]
    d = os.path.join(scratch, "listing")
    os.makedirs(d)
    with open(os.path.join(d, "page1.json"), "w") as f:
        json.dump([{"sha": "a" * 40, "html_url": "https://github.com/o/r/commit/" + "a" * 40,
                    "commit": {"message": "Fix crash\n\nbody", "author": {"name": "x", "date": "2023-05-01T00:00:00Z"}}},
                   {"sha": "b" * 40, "html_url": "https://github.com/o/r/commit/" + "b" * 40,
                    "commit": {"message": "Docs", "author": {"name": "y", "date": "2024-05-01T00:00:00Z"}}}], f)
    lst = RD.read_commit_listing(spark, d, "2023-03-01", "2024-02-28").collect()
    assert [(r.title) for r in lst] == ["Fix crash"]
    pages = spark.createDataFrame([("u1", "<html/>")], "url string, html string")
    urls = spark.createDataFrame([("u1",), ("u2",)], "url string")
    got = {r.url: r.html for r in RD.page_content(urls, pages).collect()}
    assert got == {"u1": "<html/>", "u2": None}
