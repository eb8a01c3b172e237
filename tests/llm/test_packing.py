import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from faultline.llm import packing as P
from tests.llm.conftest import EDGES

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


ODD = ["It's we'll don't 'sharp 's", "ΣΑΣ Οδυσσεύς", "İstanbul ﬁne ſharp Kelvin", "a b c\x1cd", "<|endoftext|>x <|startoftext|>", "café Café ÀÉÎ ñ ß ẞ",
       "x1y2 3.14 !!?! a.b,c ...end", "word.\x00word", "漢字かな 🙂🙂", "ÄÖÜ.. ünder,", "DŽ ǅ Ǆ ÷×", "a'b 'S 'LL ends'"]


def test_cached_words_give_the_tokenizers_ids():
    tokenizer, cache = Tokenizer.from_file(PATH), P.WordCache(PATH)
    for text in ODD + [t for _, t in EDGES if t]:
        assert cache.encode(text.encode()) == ids(tokenizer, text)[:-1].tobytes(), text


def test_edges(edges):
    tokenizer = Tokenizer.from_file(PATH)
    rows = P.pack_documents(edges, PATH).collect()
    want = []
    for k, t in EDGES:
        x = ids(tokenizer, t)
        want += [(k, i // 2048, i, len(x[i:i + 2048]), zlib.crc32(x[i:i + 2048].tobytes())) for i in range(0, len(x), 2048)]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    whole(rows, 2048)


def whole(rows, capacity):
    """Sequences are gapless from 0 and within capacity."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_empty(nothing):
    assert P.pack_documents(nothing, PATH).count() == 0


def optimum(lengths, capacity):
    best = [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for j in {r: k for k, r in enumerate(rooms) if r >= lengths[i]}.values():
            place(i + 1, rooms[:j] + [rooms[j] - lengths[i]] + rooms[j + 1:])
        place(i + 1, rooms + [capacity - lengths[i]])
    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(12))
def test_bound_is_below_the_optimum_and_fit_above(seed):
    r = np.random.default_rng(seed)
    lengths = np.sort(r.integers(1, 31, r.integers(1, 11)))[::-1].copy()
    bins, _ = P.best_fit(lengths, 30)
    best = optimum(lengths.tolist(), 30)
    assert P.lower_bound(lengths, 30) <= best <= bins.max() + 1


def test_bounds_beyond_the_sum():
    assert P.lower_bound(np.array([16] * 5), 30) == 5  # over half: one each
    assert P.lower_bound(np.array([11] * 6), 30) == 3  # over a third: two each
    assert P.lower_bound(np.zeros(0, np.int64), 30) == 0


@pytest.mark.parametrize("size", [40, 100000])
def test_partitions_exchange_their_loose_bins(spark, size):
    r = np.random.default_rng(4)
    lengths = r.integers(1, 70, 1500).tolist()
    table = spark.createDataFrame(list(enumerate(lengths)), "pid long, length long")
    rows = {x.pid: x for x in P.pack(table, 100, size).collect()}
    assert len(rows) == len(lengths)
    from types import SimpleNamespace
    n = whole([SimpleNamespace(sequence_id=x.sequence, offset=x.place, length=lengths[p]) for p, x in rows.items()], 100)
    bound = P.lower_bound(np.array(lengths), 100)
    assert bound <= n <= (1.05 if size == 40 else 1.01) * bound + 1


def test_exchange_saves_bins(spark):
    """Partitions that each have a gap of their own close it together."""
    lengths = [51] * 40 + [49] * 40 + [33] * 60 + [34] * 30
    table = spark.createDataFrame(list(enumerate(lengths)), "pid long, length long")
    alone = P.ROUNDS
    try:
        P.ROUNDS = 0
        before = P.pack(table, 100, 10).select("sequence").distinct().count()
    finally:
        P.ROUNDS = alone
    assert P.pack(table, 100, 10).select("sequence").distinct().count() < before
