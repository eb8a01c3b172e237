"""Byte strings, word sequences and lines against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from faultline.llm import doubling, linededup, suffix
from tests.llm.conftest import EDGES

LAST = (1 << 63) - 1


def multiset(rows):
    return sorted(map(repr, rows))


def bytes_brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(x[i:i + length] for x in texts for i in range(len(x) - length + 1))
    out = []
    for (k, _), x in zip(rows, texts):
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if count[x[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((k, len(x), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(x, gone) if not g)).hexdigest()))
    return out


def words_brute(rows, window):
    texts = [(LAST if k is None else k, (t or "").encode().split()) for k, t in rows]
    first = {}
    for k, w in texts:
        for i in range(len(w) - window + 1):
            g = tuple(w[i:i + window])
            first[g] = min(first.get(g, LAST), k)
    out = []
    for (key, _), (k, w) in zip(rows, texts):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < k:
                gone[i:i + window] = [True] * window
        out.append((key, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


def lines_brute(rows, run):
    texts = [(LAST if k is None else k, t.split("\n") if t else []) for k, t in rows]
    first = {}
    for k, lines in texts:
        for i in range(len(lines) - run + 1):
            g = tuple(lines[i:i + run])
            first[g] = min(first.get(g, (LAST + 1, 0)), (k, i))
    out = []
    for (key, _), (k, lines) in zip(rows, texts):
        gone = set()
        for i in range(len(lines) - run + 1):
            at = first[tuple(lines[i:i + run])]
            if at[0] < k or at[0] == k and at[1] < i and tuple(lines[i:i + run]) in [tuple(lines[j:j + run]) for j in range(i)]:
                gone |= set(range(i, i + run))
        kept = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out.append((key, len(lines), sorted(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def random_rows(seed, n=120):
    """Documents with shared passages at random places, copies and near copies."""
    r = np.random.default_rng(seed)
    word = lambda: "".join(r.choice(list("abcdé"), r.integers(1, 9)))
    passages = [[word() for _ in range(r.integers(10, 160))] for _ in range(8)]
    rows = []
    for i in range(n):
        words = [word() for _ in range(r.integers(0, 150))]
        for _ in range(r.integers(0, 3)):
            p = passages[r.integers(len(passages))]
            a = r.integers(0, len(p) // 2)
            at = r.integers(0, len(words) + 1)
            words[at:at] = p[a:]
        if rows and i % 9 == 0:
            words = rows[-1][1].split()
            if words and i % 2:
                words[r.integers(len(words))] = "edit"
        rows.append((int(i // 1.02), "".join(w + (" " if r.random() < 0.9 else "\n") for w in words)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


# ----------------------------------------------------------------- bytes

def bytes_got(df):
    return [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()]


def test_bytes_edges(edges):
    assert multiset(bytes_got(suffix.repeated_bytes(edges))) == multiset(bytes_brute(EDGES, 400))


@pytest.mark.parametrize("length,bucket", [(64, 32 << 20), (100, 3000), (131, 1)])
def test_bytes_random(spark, length, bucket):
    rows = random_rows(length)
    assert multiset(bytes_got(suffix.repeated_bytes(frame(spark, rows), length, bucket_bytes=bucket))) == multiset(bytes_brute(rows, length))


def test_bytes_one_hot_bucket_is_sliced(spark):
    """A passage that all documents share, in changing surroundings."""
    passage = "".join(chr(97 + i * i * 7 % 26) for i in range(120))
    rows = [(i, f"{i:050d}{passage}{i % 7:030d}{i:05d}") for i in range(150)]
    assert multiset(bytes_got(suffix.repeated_bytes(frame(spark, rows), 128, bucket_bytes=2000))) == multiset(bytes_brute(rows, 128))


@pytest.mark.parametrize("bucket", [2000, 20_000])
def test_bytes_shared_core_in_changing_surroundings(spark, bucket):
    """A third of the texts share a passage little longer than a string; what is around it differs in each."""
    r = np.random.default_rng(9)
    noise = lambda n: "".join(r.choice(list("abcdefgh"), n))
    passage = noise(430)
    rows = [(i, noise(int(r.integers(30, 500))) + (passage if i % 3 == 0 else "") + noise(int(r.integers(30, 500)))) for i in range(150)]
    got = bytes_got(suffix.repeated_bytes(frame(spark, rows), 400, bucket_bytes=bucket))
    assert multiset(got) == multiset(bytes_brute(rows, 400))
    assert all(n >= 430 for k, _, n, _, _ in got if k % 3 == 0)


def test_slices_of_a_hot_core_are_bounded():
    """Slices of one bucket that share their core and differ around it: cut to single
    strings, no bucket holds more than one row of a gather, and every repeat is found."""
    r = np.random.default_rng(3)
    core = r.integers(97, 123, 400).astype(np.uint8).tobytes()
    rows = [(i.to_bytes(8, "little"), 0, 200, False, r.integers(97, 123, 20).astype(np.uint8).tobytes() + core + r.integers(97, 123, 20).astype(np.uint8).tobytes(), 1)
            for i in range(600)]
    kinds = (pa.binary(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int64())
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["id", "start", "anchor", "several", "bytes", "bucket"])
    out = [x for b in suffix._sort(400, 5000)(iter([batch])) for x in b.to_pylist()]
    sent, known = [x for x in out if x["bytes"] is not None], [x for x in out if x["bytes"] is None]
    per_bucket = Counter(x["bucket"] for x in sent)
    assert max(per_bucket.values()) <= 2 and all(len(x["bytes"]) == 400 for x in sent)
    whole = [x for x in sent if x["bytes"] == core]
    assert len(whole) == 1 and whole[0]["several"]
    assert sum((x["start"], x["end"]) == (20, 420) for x in known) == 599


def test_bytes_empty(nothing):
    assert suffix.repeated_bytes(nothing).count() == 0


def test_cover_sample_ranks_settle_long_ties():
    r = np.random.default_rng(5)
    base = r.integers(97, 99, 3000).astype(np.uint8)
    data = np.concatenate([base, base[11:2500], r.integers(97, 99, 700).astype(np.uint8), base[5:900]])
    starts = np.arange(len(data) - 400 + 1)
    text = data.tobytes()
    count = Counter(text[i:i + 400] for i in starts)
    want = np.array([count[text[i:i + 400]] > 1 for i in starts])
    assert (suffix.repeated_starts(data, starts, 400) == want).all() and want.any() and not want.all()


def test_every_two_residues_have_a_shift_in_the_cover():
    for a in range(7):
        for b in range(7):
            assert any((a + s) % 7 in suffix._COVER and (b + s) % 7 in suffix._COVER for s in range(7))


# ----------------------------------------------------------------- words

def words_got(df):
    return [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()]


def test_words_edges(edges):
    assert multiset(words_got(doubling.repeated_words(edges))) == multiset(words_brute(EDGES, 13))


@pytest.mark.parametrize("seed", [1, 2])
def test_words_random(spark, seed):
    rows = random_rows(seed)
    assert multiset(words_got(doubling.repeated_words(frame(spark, rows), 13))) == multiset(words_brute(rows, 13))


def test_levels_go_on_until_no_candidate_survives(spark):
    shared = [f"s{i}" for i in range(110)]
    rows = [(1, " ".join(["a"] + shared)), (2, " ".join(["b"] + shared[:60])), (3, "c " + " ".join(shared[90:103])), (4, " ".join(f"z{i}" for i in range(90)))]
    rows.append((5, "q " + " ".join(shared)))
    got = {r.doc_id: r.longest_level for r in doubling.repeated_words(frame(spark, rows)).collect()}
    assert got == {1: 104, 2: 52, 3: 13, 4: 0, 5: 104}


def test_words_empty(nothing):
    assert doubling.repeated_words(nothing).count() == 0


# ----------------------------------------------------------------- lines

def lines_got(df):
    return [(r.doc_id, r.n_lines, list(r.removed), r.kept_sha256) for r in df.collect()]


def test_lines_edges(edges):
    assert multiset(lines_got(linededup.dedup_report(edges))) == multiset(lines_brute(EDGES, 3))


@pytest.mark.parametrize("run", [1, 2, 3, 5])
def test_lines_random(spark, run):
    r = np.random.default_rng(run)
    pool = [f"line {i}" for i in range(12)]
    rows = [(i, "\n".join(pool[j] for j in r.integers(0, 12, r.integers(0, 40)))) for i in range(60)]
    assert multiset(lines_got(linededup.dedup_report(frame(spark, rows), run))) == multiset(lines_brute(rows, run))


def passages_brute(rows, run, words):
    """Later repeats of runs of ``run`` lines, and of shorter ones with enough words."""
    texts = [(LAST if k is None else k, t.split("\n") if t else []) for k, t in rows]

    def units(lines):
        for k in range(1, run + 1):
            for i in range(len(lines) - k + 1):
                if k == run or sum(len(x.encode().split()) for x in lines[i:i + k]) >= words:
                    yield i, tuple(lines[i:i + k])
    first = {}
    for k, lines in texts:
        for _, g in units(lines):
            first[g] = min(first.get(g, LAST), k)
    out = []
    for (key, _), (k, lines) in zip(rows, texts):
        gone, seen = set(), set()
        for i, g in units(lines):
            if first[g] < k or g in seen:
                gone |= set(range(i, i + len(g)))
            seen.add(g)
        kept = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out.append((key, len(lines), sorted(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_passages_of_one_or_two_lines_between_unshared_lines(spark):
    long, half = " ".join(f"lang{i}" for i in range(60)), [" ".join(f"{c}{i}" for i in range(30)) for c in "ab"]
    own = lambda i: f"own line {i}"
    rows = [(1, f"{own(1)}\n{long}\n{own(2)}"), (2, f"{own(3)}\n{long}\n{own(4)}"), (3, long), (4, "\n".join([own(5), *half])),
            (5, "\n".join([*half, own(6)])), (6, f"{half[0]}\n{own(7)}\n{half[1]}"), (7, f"{own(8)}\nx {long}\n{own(9)}\nx {long}"), (None, f"{long}\n{own(10)}")]
    rows += [(i, "\n".join(x)) for i, x in zip(range(20, 60), np.random.default_rng(4).choice([long, *half, "s", "t", "u v", own(11)], (40, 5)).tolist())]
    got = lines_got(linededup.dedup_report(frame(spark, rows), words=50))
    assert multiset(got) == multiset(passages_brute(rows, 3, 50))
    gone = {k: g for k, _, g, _ in got}
    assert [gone[k] for k in (1, 2, 3, 4, 5, 6, 7, None)] == [[], [1], [0], [], [0, 1], [], [3], [0]]


def test_dedup_lines_keeps_all_columns_and_rows(edges):
    out = linededup.dedup_lines(edges)
    assert out.columns == edges.columns and out.count() == edges.count()
    want = {k: (t, d) for (k, _, _, d), (_, t) in zip(lines_brute(EDGES, 3), EDGES) if k is not None}
    for r in out.where("doc_id IS NOT NULL").collect():
        assert hashlib.sha256((r.text or "").encode()).hexdigest() == want[r.doc_id][1]
        assert (r.text is None) == (want[r.doc_id][0] is None)


def test_lines_empty(nothing):
    assert linededup.dedup_report(nothing).count() == 0 and linededup.dedup_lines(nothing).count() == 0


def tied_rows():
    """Null ids and one id on many texts, all with a passage that a smaller id has
    too; and a passage that only texts without ids share."""
    shared, tied = [f"line {i} of some shared words" for i in range(6)], [f"tied line {i} of some words" for i in range(6)]
    text = lambda i, lines: "\n".join([f"head {i}", *lines, f"tail {i}"])
    return [(3, text("a", shared)), *[(None, text(i, shared)) for i in range(30)], *[(7, text(f"r{i}", shared)) for i in range(30)],
            *[(None, text(f"t{i}", tied)) for i in range(9)]]


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_texts_of_equal_order_in_one_task(spark, parts):
    rows = tied_rows()
    first, rest = (spark.createDataFrame(x, "doc_id long, text string") for x in (rows[:1], rows[1:]))
    docs = first.coalesce(1).union(rest.coalesce(parts))
    assert multiset(words_got(doubling.repeated_words(docs, 13))) == multiset(words_brute(rows, 13))
    assert multiset(lines_got(linededup.dedup_report(docs))) == multiset(lines_brute(rows, 3))


def test_a_hot_passage_asks_once_a_task(spark):
    """Half of all documents hold one passage: one row a task asks for it."""
    from faultline.llm.exchange import _WIRE, _send
    rows = [(i, "hot words " * 10 if i % 2 else f"text {i} " * 10) for i in range(400)]
    df = frame(spark, rows).select(suffix.text_id(suffix.F.col("text")).substr(1, 8).alias("short"), "text")
    wire = df.mapInArrow(_send(doubling._gram_items(13, 6), 4, False, False), _WIRE).where("asks").collect()
    asked = defaultdict(int)
    for r in wire:
        for h in np.frombuffer(r.hashes, np.uint64):
            asked[int(h)] += 1
    assert max(asked.values()) <= 5


def test_keys_of_text(spark):
    """Keys that are no numbers have an order too: one document of each group of copies keeps its lines."""
    lines = "\n".join(f"line {i} of some shared words" for i in range(20))
    rows = [("doc-a", lines + "\nown a"), ("doc-b", lines + "\nown b"), ("", lines + "\nown c"), (None, lines + "\nown d"), ("x", "alone")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    gone = {r.doc_id: r.n_removed for r in linededup.dedup_report(docs).collect()}
    assert sorted(gone[k] for k in ("doc-a", "doc-b", "")) == [0, 20, 20] and gone[None] == 20 and gone["x"] == 0
    words = {r.doc_id: r.n_removed for r in doubling.repeated_words(docs).collect()}
    assert sorted(words[k] > 100 for k in ("doc-a", "doc-b", "")) == [False, True, True] and words[None] > 100 and words["x"] == 0
    numbers = spark.createDataFrame([("10", lines), ("9", lines)], "doc_id string, text string")
    assert {r.doc_id: r.n_removed for r in linededup.dedup_report(numbers).collect()} == {"9": 0, "10": 20}
