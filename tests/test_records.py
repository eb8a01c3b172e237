import json
import os

from pyspark.sql import functions as F

from faultline.operators.records import record_text
from faultline.sources import readers as RD
from faultline.sources import sinks as K
from faultline.streaming.ingest import flatten_records, ingest

from conftest import FIXTURES

RECORDS = os.path.join(FIXTURES, "records")


def test_reader_keeps_only_json(spark):
    df = RD.read_commit_records(spark, RECORDS, mode="FAILFAST")
    assert df.count() == 3
    assert "security" in df.columns


def test_record_text_rules(spark):
    df = RD.read_commit_records(spark, RECORDS)
    out = {r.commit_index: r.text for r in flatten_records(df).collect()}
    assert out["0000001"] == "fix crash | src/a.ts"
    # empty comment kept as an empty segment, issue title prefixed, security included
    assert out["0000002"] == ("handle error | null check | src/b.ts src/c.ts | handle error | add guard |  | "
                              "Issue title:app crash | see log | advisory | cve")
    # commit NULL: nothing at all, even with a PR
    assert out["0000003"] is None


def test_sink_roundtrip_and_partitioning(spark, scratch):
    df = RD.read_commit_records(spark, RECORDS)
    K.write_commit_records(df, os.path.join(scratch, "records"))
    back = spark.read.parquet(os.path.join(scratch, "records"))
    assert sorted(r.repo for r in back.select("repo").distinct().collect()) == ["acme_widgets", "other_repo"]
    assert back.where(F.col("commit_index") == "0000003").first().issues is None


def test_streaming_equals_batch(spark, scratch):
    out_dir = os.path.join(scratch, "stream_out")
    ingest(spark, RECORDS, out_dir, name="t1", checkpoint=os.path.join(scratch, "ckpt"))
    streamed = sorted(tuple(r) for r in spark.read.parquet(out_dir).collect())
    batch = sorted(tuple(r) for r in flatten_records(RD.read_commit_records(spark, RECORDS)).collect())
    assert streamed == batch
    # a second run over the same folder adds nothing (state + file log in the checkpoint)
    ingest(spark, RECORDS, out_dir, name="t1", checkpoint=os.path.join(scratch, "ckpt"))
    assert spark.read.parquet(out_dir).count() == 3


def test_small_json_inputs(spark, scratch):
    d = os.path.join(scratch, "in")
    os.makedirs(d)
    with open(os.path.join(d, "job.json"), "w") as f:
        f.write('{"token": "secret", "urls": ["https://github.com/o/r/commit/abc1234"]}')
    with open(os.path.join(d, "bad.json"), "w") as f:
        f.write('{"token": ')
    urls = RD.read_crawl_job(spark, d)
    assert urls.columns == ["url"]
    assert [r.url for r in urls.collect()] == ["https://github.com/o/r/commit/abc1234"]
    g = os.path.join(scratch, "gold")
    os.makedirs(g)
    with open(os.path.join(g, "gold.json"), "w") as f:
        f.write('{"index": {"abc1234": "Logic Error", "def5678": "UI Bug"}}')
    assert sorted(tuple(r) for r in RD.read_gold_labels(spark, g).collect()) == \
        [("abc1234", "Logic Error"), ("def5678", "UI Bug")]
    s = os.path.join(scratch, "summary")
    os.makedirs(s)
    with open(os.path.join(s, "s.json"), "w") as f:
        f.write('{"summary": {"total_tasks": 3, "tasks_with_predictions": 2, "tasks_without_predictions": 1, '
                '"total_categories": 1}, "categories": {"UI Bug": {"count": 2, "indices": ["a1", "b2"]}}}')
    assert sorted(tuple(r) for r in RD.read_prediction_summary(spark, s).collect()) == \
        [("UI Bug", "a1"), ("UI Bug", "b2")]
    r = os.path.join(scratch, "repos")
    os.makedirs(r)
    with open(os.path.join(r, "r.json"), "w") as f:
        f.write('{"repository_name": ["n8n", "nest"]}')
    assert [tuple(x) for x in RD.read_repository_list(spark, r).orderBy("position").collect()] == \
        [(0, "n8n"), (1, "nest")]


def test_record_text_on_label_tasks(spark):
    df = RD.read_commit_records(spark, RECORDS)
    rec = F.struct("commit", "pull_requests", "issues", "security")
    texts = [r.t for r in df.select(record_text(rec).alias("t")).orderBy("commit_index").collect()]
    assert texts[0] == "fix crash | src/a.ts"


def test_document_dedup_stream_equals_batch(spark, scratch):
    from faultline.streaming.ingest import dedup_stream
    from conftest import SF_SMALL
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out_dir = os.path.join(scratch, "dedup")
    dedup_stream(spark, SF_SMALL, "documents.parquet", docs.schema, F.sha2("text", 256), out_dir,
                 "docs", select=["text"], checkpoint=os.path.join(scratch, "ckpt-docs"))
    streamed = spark.read.parquet(out_dir)
    assert streamed.count() == docs.select("text").distinct().count()
    assert streamed.select("text").distinct().count() == streamed.count()


def test_streaming_new_file_with_seen_key(spark, scratch):
    import shutil
    src = os.path.join(scratch, "incoming")
    shutil.copytree(RECORDS, src)
    out_dir = os.path.join(scratch, "out")
    ckpt = os.path.join(scratch, "ckpt2")
    ingest(spark, src, out_dir, name="t2", checkpoint=ckpt)
    with open(os.path.join(src, "output-0000001_again.json"), "w") as f:   # re-delivered key
        f.write(open(os.path.join(RECORDS, "output-0000001_acme_widgets.json")).read())
    rec = json.loads(open(os.path.join(RECORDS, "output-0000001_acme_widgets.json")).read())
    rec["commit_index"] = "0000009"
    with open(os.path.join(src, "output-0000009_acme_widgets.json"), "w") as f:  # new key
        f.write(json.dumps(rec))
    ingest(spark, src, out_dir, name="t2", checkpoint=ckpt)
    keys = sorted(r.commit_index for r in spark.read.parquet(out_dir).collect())
    assert keys == ["0000001", "0000002", "0000003", "0000009"]
