import random
import re

import numpy as np
import pytest

from faultline.llm import decontam as D
from faultline.llm.fmindex import FMIndex, suffix_array
from tests.llm.conftest import EDGES

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, window=10):
    grams = {}
    for name, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            grams.setdefault(tuple(w[i:i + window]), set()).add(name)
    out = []
    for k, text in rows:
        w, hit, found = words(text), set(), set()
        for g, names in grams.items():
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i:i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    found |= names - {None}
        out.append((k, len(w), len(hit), sorted(found)))
    return sorted(map(repr, out))


def got(df):
    return sorted(map(repr, ((r.doc_id, r.n_words, r.n_hit, list(r.items)) for r in df.collect())))


ITEMS = [("1", " ".join(f"passage{i} über words" for i in range(5, 9))), ("2", "Of of!"), ("2", "Of of!"), ("3", None), ("4", "..."), (None, "émoji ñ 漢字"),
         ("10", "one two three four five six seven eight nine ten eleven twelve"), ("5", " ".join(f"w{i}" for i in range(40, 70)))]


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id string, text string")


def test_edges(spark, edges):
    assert got(D.find(edges, benchmark(spark, ITEMS))) == brute(EDGES, ITEMS)


def test_blocks_of_the_benchmark_are_merged(spark, edges, monkeypatch):
    monkeypatch.setattr(D, "BENCHMARK_BYTES", 150)
    monkeypatch.setattr(D, "BLOCKS_A_JOB", 2)
    assert got(D.find(edges, benchmark(spark, ITEMS))) == brute(EDGES, ITEMS)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random(spark, seed):
    r = random.Random(seed)
    text = lambda n: " ".join(r.choice(["a", "B", "c", "dé"]) + r.choice(["", "", ".", "-x"]) for _ in range(n))
    rows = [(i, text(r.randrange(0, 80))) for i in range(60)]
    items = [(str(i), text(r.randrange(0, 14))) for i in range(30)]
    assert got(D.find(spark.createDataFrame(rows, "doc_id long, text string"), benchmark(spark, items), 4)) == brute(rows, items, 4)


def test_empty_tables(spark, edges, nothing):
    assert D.find(nothing, benchmark(spark, ITEMS)).count() == 0
    assert all(r.n_hit == 0 and r.items == [] for r in D.find(edges, benchmark(spark, [])).collect())


def test_spans_are_cut_from_the_text(spark):
    rows = [(1, "début, One two THREE four fin ñ"), (2, "clean text"), (3, "one two three four"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = D.remove_spans(D.find(docs, benchmark(spark, [("1", "one two three four")])))
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "début,  fin ñ", 2: "clean text", 3: "", 4: None}


@pytest.mark.parametrize("seed", range(5))
def test_index_finds_and_locates_all(seed):
    r = np.random.default_rng(seed)
    text = np.append(r.integers(0, 6, 400), 0)
    index = FMIndex(text, 5)
    for n in (1, 2, 3, 5):
        patterns = np.array([[*p] for p in np.ndindex(*(5,) * min(n, 3))]) + 1
        patterns = np.concatenate([patterns, patterns[:, :1].repeat(n - patterns.shape[1], 1)], axis=1) if patterns.shape[1] < n else patterns
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high):
            want = [i for i in range(len(text) - n + 1) if (text[i:i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_suffix_array_orders_separators_by_place():
    text = np.array([2, 1, 0, 2, 1, 0])
    assert suffix_array(text).tolist() == [2, 5, 1, 4, 0, 3]
