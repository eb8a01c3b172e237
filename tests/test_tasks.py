import json
import os

from faultline.operators import tasks as TK
from faultline.sources.readers import read_label_tasks

REC = {"commit_index": "abc1234", "commit_url": "https://github.com/o/r/commit/abc1234",
       "commit": {"commit_message": ["fix", "crash"], "description": [], "changed_files_count": 1,
                  "changed_files": ["a.ts"], "changed_files_content": [], "parent": "p"},
       "pull_requests": None, "issues": None, "security": None}


def _choice(*labels):
    return {"result": [{"value": {"choices": list(labels)}}]}


def _write_tasks(path):
    tasks = [
        {"id": 1, "project": 3, "data": REC, "annotations": [{"result": []}, _choice("Logic Error", "UI Bug")],
         "predictions": [_choice("Logic Error")]},
        {"id": 2, "project": 3, "data": dict(REC, commit_index="def5678"), "annotations": [],
         "predictions": [_choice("UI Bug"), {"result": []}, _choice("Type Error", "UI Bug")]},
        {"id": 3, "project": 3, "data": dict(REC, commit_index=None), "annotations": None,
         "predictions": [_choice("Test Fault")]},
        {"id": 4, "project": 3, "data": dict(REC, commit=None), "annotations": [_choice("API Misuse")],
         "predictions": []},
        {"id": 5, "project": 9, "data": REC, "annotations": [], "predictions": []},
    ]
    os.makedirs(path)
    for t in tasks:
        with open(os.path.join(path, f"task{t['id']}.json"), "w") as f:
            json.dump(t, f)


def test_label_task_operators(spark, scratch):
    path = os.path.join(scratch, "tasks")
    _write_tasks(path)
    tasks = read_label_tasks(spark, path, project_id=3)
    assert tasks.count() == 4
    train = {r.id: (r.label, r.text) for r in TK.training_rows(tasks).collect()}
    assert train == {1: ("Logic Error", "fix crash | a.ts")}        # task 4 has no commit -> no text
    pred = sorted(r.id for r in TK.prediction_rows(tasks).collect())
    assert pred == [2, 3]
    pairs = sorted((r.category, r["index"]) for r in TK.category_pairs(tasks).collect())
    assert pairs == [("Logic Error", "abc1234"), ("Type Error", "def5678"), ("UI Bug", "def5678"),
                     ("UI Bug", "def5678")]                          # task 3 has no commit index (F14)
    counts = {r.category: r["count"] for r in TK.category_counts(TK.category_pairs(tasks)).collect()}
    assert counts == {"Logic Error": 1, "Type Error": 1, "UI Bug": 2}
    s = TK.task_summary(tasks).first()
    assert (s.total_tasks, s.tasks_with_predictions, s.tasks_without_predictions, s.total_categories) == (4, 3, 1, 3)
