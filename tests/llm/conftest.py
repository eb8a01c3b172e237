import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (sys.path[0], os.environ.get("PYTHONPATH", "")) if x)

SMALL = "/root/testdata/sf0.001"

_PASSAGE = " ".join(f"passage{i} über words" for i in range(40))
#: Nulls, empty and very long texts, ties, repeated rows; an extra column whose names clash with results.
EDGES = [
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (2, None), (3, ""), (4, " \t\n"), (None, "a text without a key " * 4), (None, None),
    (5, "of " * 3000), (6, "Of of OF " * 2), (7, _PASSAGE), (8, "prefix " + _PASSAGE + " suffix"), (8, "prefix " + _PASSAGE + " suffix"),
    (9, _PASSAGE), (10, "A\nB\nC\nD\nA\nB\nC\nD\n"), (11, "x\nB\nC\nD\ny"), (12, "x" * 900), (13, "ab" * 600 + "\n" + "x" * 500),
    (14, "🙂 émoji ñ 漢字 " * 60), (15, "\n\n\n\n\n\n"), (16, " ".join(f"w{i}" for i in range(20000))), (17, " ".join(f"w{i}" for i in range(50, 9000))),
]


@pytest.fixture(scope="session")
def edges(spark):
    rows = [(k, t, "n", 7, 1) for k, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, N_WORDS string, fail_bits int, items int")


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.where("false")
