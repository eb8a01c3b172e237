"""The write manifest (K7) and the bounded state of the watched folder."""

import json
import os
import time

import pytest

from faultline.sources import manifest as MF
from faultline.streaming import ingest as I

SCHEMA = "id long, predicted string"


def frame(spark, ids):
    return spark.createDataFrame([(i, f"c{i % 2}") for i in ids], SCHEMA)


def ids(spark, path):
    return sorted((r.id, r.model_version, r.batch) for r in MF.read_predictions(spark, path, SCHEMA).collect())


def test_a_job_that_runs_twice_or_ends_early(spark, scratch):
    path = os.path.join(scratch, "p")
    assert ids(spark, path) == []
    assert MF.write_predictions(frame(spark, range(5)), path, "day-1", "v1")
    assert not MF.write_predictions(frame(spark, range(5)), path, "day-1", "v1")
    # Ended between write and commit, then run again.
    MF.stage_batch(frame(spark, range(5, 8)), path, "day-2", "v1")
    assert len(ids(spark, path)) == 5
    assert MF.write_predictions(frame(spark, range(5, 8)), path, "day-2", "v1")
    assert ids(spark, path) == [(i, "v1", "day-1") for i in range(5)] + [(i, "v1", "day-2") for i in range(5, 8)]
    # Two runs of one batch at once: the first commit stays.
    a, b = (MF.stage_batch(frame(spark, [k]), path, "day-3", "v2") for k in (90, 91))
    assert MF.commit_batch(spark, path, "day-3", b, "v2") and not MF.commit_batch(spark, path, "day-3", a, "v2")
    assert [x for x in ids(spark, path) if x[2] == "day-3"] == [(91, "v2", "day-3")]
    before = ids(spark, path)
    assert MF.remove_uncommitted(spark, path) == 2 and MF.remove_uncommitted(spark, path) == 0
    assert ids(spark, path) == before
    assert sorted(r.batch for r in MF.committed(spark, path).collect()) == ["day-1", "day-2", "day-3"]


def test_batch_ids_are_names(spark, scratch):
    for bad in ("", "a/b", "..", "x y"):
        with pytest.raises(ValueError):
            MF.write_predictions(frame(spark, [1]), os.path.join(scratch, "q"), bad, "v1")


def test_state_falls_after_the_horizon(spark, scratch):
    src, out, ckpt = (os.path.join(scratch, x) for x in ("src", "out", "ckpt"))
    os.makedirs(src)
    now, day, names = time.time(), 86400, []

    def land(key, days):
        names.append(f"{len(names):03d}.json")
        path = os.path.join(src, names[-1])
        with open(path, "w") as f:
            json.dump({"commit_index": key, "commit_url": f"u/{key}", "commit": {"commit_message": [key]}}, f)
        os.utime(path, (now + days * day,) * 2)

    def run():
        q = I.ingest(spark, src, out, name="h", checkpoint=ckpt, horizon="10 days", max_files_per_trigger=1)
        return I.state_counts(q)

    land("a", -100)
    land("b", -99)
    land("a", -95)  # a copy inside the horizon
    first = run()
    assert first["copies"] == 1 and first["late"] == 0 and first["keys_held"] == 2
    land("c", -50)  # the watermark passes a and b
    land("d", -49)
    second = run()
    assert second["keys_held"] == 2
    land("e", -90)  # older than the horizon
    land("c", -48)
    third = run()
    assert third["late"] == 1 and third["copies"] == 1 and third["keys_held"] == 2
    assert sorted(r.commit_index for r in spark.read.parquet(out).collect()) == ["a", "b", "c", "d"]


def test_stream_equals_batch_inside_the_horizon(spark, scratch):
    src, out = os.path.join(scratch, "src"), os.path.join(scratch, "out")
    os.makedirs(src)
    for i in range(40):
        with open(os.path.join(src, f"{i}.json"), "w") as f:
            json.dump({"commit_index": f"k{i % 13}", "commit_url": "u", "commit": {"commit_message": ["m"]}}, f)
    q = I.ingest(spark, src, out, name="e", checkpoint=os.path.join(scratch, "ckpt"), horizon="1 day", max_files_per_trigger=7)
    counts = I.state_counts(q)
    assert counts["copies"] == 27 and counts["late"] == 0 and counts["keys_held"] == 13
    from faultline.sources.readers import read_commit_records
    batch = I.flatten_records(read_commit_records(spark, src).dropDuplicates(["commit_index"]))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, batch.collect()))
