"""Spelling variants of a corpus's words, found by k-d trees over letter counts.

A word is a point whose coordinates are the counts of its letters. One inserted
letter raises one count by one; one replaced letter raises one and lowers another:
an L1 distance of two at most. So near words are found by range searches, one for
words of the same length and one for words that are a letter longer.

Words of one length are cut into boxes of about ``BOX`` words by a k-d tree fitted
on a bounded sample of the words (it only sets the balance: every word has a box,
and a word asks every box its range reaches). A box is one group: its words form
a k-d tree again, all words that ask go down it together, branches beyond the range
are pruned for each of them, and what meets in a leaf is compared by letter counts
and then by the order of the letters. Of two boxes of one length the one with the
larger number is asked, so a pair is found once. A group returns one row a word,
its neighbours already counted. The leaf comparisons are made in blocks of bounded size.

Defined results: null or empty texts have no words. A null doc_id is written as an
empty string in the hash that decides which letters go. Repeated rows count each
(their words lose the same letters). Ties in n go by code point order. An empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import LOWER, UPPER, stage, staged_path, unstage

#: Letters of a word: A-Z, a-z and U+00C0 to U+00FF.
LETTERS = "[A-Za-zÀ-ÿ]+"
#: Words of a box, words of the sample that the boxes are fitted on, words of a leaf in a box.
BOX, SAMPLE, LEAF = 12_000, 100_000, 32
#: Comparisons of a leaf made at once.
BLOCK = 1 << 21
#: Coordinates: a-z and the 64 letters from U+00C0.
DIMS = 26 + 64


# -------------------------------------------------------------------- words

def words(docs: DataFrame, noise: int = 97, shortest: int = 5, fewest: int = 3) -> DataFrame:
    """(word, n): the distinct words of the texts and how often they occur. If
    ``noise`` divides the CRC-32 h of "doc_id:run", the run loses its letter h modulo
    its length. DataFrame functions only; occurrences are counted in the map task."""
    low = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(low, F.lit(LETTERS), F.lit(0))).alias("run"))
    h, size = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")), F.length("run")
    at = (h % size).cast("int")
    less = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, size))
    word = F.when(h % noise == 0, less).otherwise(F.col("run"))
    return (runs.where(size >= shortest).select(word.alias("word")).where(F.length("word") >= shortest)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= fewest))


# ------------------------------------------------------------------- points

def letters(column: pa.Array, length: int) -> np.ndarray:
    """Words of one length as rows of code points (Latin-1, one byte each)."""
    return np.frombuffer("".join(column.to_pylist()).encode("latin-1"), np.uint8).reshape(-1, length)


def points(codes: np.ndarray) -> np.ndarray:
    """Letter counts of words of one length."""
    place = np.where(codes >= 0xC0, codes.astype(np.int64) - 0xC0 + 26, codes.astype(np.int64) - 97)
    rows = np.arange(len(codes))[:, None] * DIMS
    return np.bincount((rows + place).ravel(), minlength=len(codes) * DIMS).reshape(-1, DIMS).astype(np.int32)


def signature(x: np.ndarray) -> np.ndarray:
    """128 bits a point, whose differing bits never exceed the L1 distance: the
    counts of a-z in unary up to three, the others modulo 25 up to two."""
    rare = np.zeros((len(x), 25), np.int32)
    for d in range(26, DIMS):
        rare[:, (d - 26) % 25] += x[:, d]
    bits = np.concatenate([x[:, :26] >= 1, x[:, :26] >= 2, x[:, :26] >= 3, rare >= 1, rare >= 2], axis=1)
    return np.packbits(bits, axis=1).view(np.uint64)


class Tree:
    """A k-d tree: inner nodes cut a coordinate at ``<= cut``, leaves hold rows."""

    def __init__(self, x: np.ndarray, leaf: float):
        self.nodes: list[tuple] = []
        self.n_leaves = 0
        # A coordinate's box (lo, hi) before the cut is kept, so that a search can add up distances.
        grow = [(np.arange(len(x)), {}, None, 0)]
        while grow:
            rows, box, parent, side = grow.pop()
            cut = self._cut(x[rows]) if len(rows) > leaf else None
            me = len(self.nodes)
            if parent is not None:
                self.nodes[parent] = self.nodes[parent][:4 + side] + (me,) + self.nodes[parent][5 + side:]
            if cut is None:
                self.nodes.append((-1, self.n_leaves, rows))
                self.n_leaves += 1
                continue
            d, c = cut
            lo, hi = box.get(d, (None, None))
            self.nodes.append((d, c, lo, hi, -1, -1))
            low = x[rows, d] <= c
            grow.append((rows[~low], box | {d: (c + 1, hi)}, me, 1))
            grow.append((rows[low], box | {d: (lo, c)}, me, 0))

    @staticmethod
    def _cut(x: np.ndarray) -> tuple[int, int] | None:
        """The coordinate whose median cut is the most even; None if all points are equal."""
        best, found = 0, None
        lows = (x.min(axis=0), x.max(axis=0))
        for d in np.flatnonzero(lows[0] < lows[1]).tolist():
            below = np.cumsum(np.bincount(x[:, d]))
            even = np.minimum(below, len(x) - below)
            c = int(even.argmax())
            if even[c] > best:
                best, found = int(even[c]), (d, c)
        return found

    def search(self, q: np.ndarray, up: int, down: int):
        """(leaf number, leaf rows, query rows): the leaves that hold all points whose counts
        are above those of a query by ``up`` in sum at most and below by ``down``."""
        if not len(q):
            return
        zero = np.zeros(len(q), np.int32)
        walk = [(0, np.arange(len(q)), zero, zero)]
        while walk:
            at, rows, above, below = walk.pop()
            node = self.nodes[at]
            if node[0] < 0:
                yield node[1], node[2], rows
                continue
            d, c, lo, hi, left, right = node
            v = q[rows, d]
            # Left of the cut a point has c at most: a query above it must come down.
            more = np.maximum(v - c, 0) - (0 if hi is None else np.maximum(v - hi, 0))
            keep = below + more <= down
            if keep.any():
                walk.append((left, rows[keep], above[keep], (below + more)[keep]))
            more = np.maximum(c + 1 - v, 0) - (0 if lo is None else np.maximum(lo - v, 0))
            keep = above + more <= up
            if keep.any():
                walk.append((right, rows[keep], (above + more)[keep], below[keep]))


# ---------------------------------------------------------------- one box

def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def one_inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether b is a with one letter inserted: what they share at the start and at the end covers a."""
    same = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
    ends = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return same + ends >= a.shape[1]


def _pairs(tree: Tree, signs: np.ndarray, codes: np.ndarray, q_signs: np.ndarray, q_codes: np.ndarray, q_points: np.ndarray, longer: bool, own: bool):
    """(query, word) rows of near words in blocks. ``own``: the queries are the box's words."""
    most, near = (1, one_inserted) if longer else (2, one_replaced)
    for _, rows, asks in tree.search(q_points, 1, 0 if longer else 1):
        step = max(1, BLOCK // len(rows))
        for i in range(0, len(asks), step):
            part = asks[i: i + step]
            apart = np.bitwise_count(q_signs[part, None, 0] ^ signs[None, rows, 0]).astype(np.int16)
            apart += np.bitwise_count(q_signs[part, None, 1] ^ signs[None, rows, 1])
            hit_q, hit_w = np.nonzero(apart <= most)
            hit_q, hit_w = part[hit_q], rows[hit_w]
            if own:
                once = hit_q < hit_w
                hit_q, hit_w = hit_q[once], hit_w[once]
            for k in range(0, len(hit_q), BLOCK // 16):
                x, y = hit_q[k: k + BLOCK // 16], hit_w[k: k + BLOCK // 16]
                ok = near(q_codes[x], codes[y])
                yield x[ok], y[ok]


FOUND = "word string, n long, n_near long, best_n long, best string"


def _box(frame: pa.Table) -> pa.Table:
    """Near words of one box: rows (length, box, word, n, asks); asks: 0 the box's own
    words, 1 words of the same length, 2 words that are a letter shorter."""
    length = frame["length"][0].as_py()
    frame = frame.sort_by([("asks", "ascending"), ("word", "ascending")])
    kinds = frame["asks"].to_numpy()
    own = frame.slice(0, int((kinds == 0).sum()))
    if not len(own):
        return pa.table({"word": pa.array([], pa.string()), "n": pa.array([], pa.int64()), "n_near": pa.array([], pa.int64()),
                         "best_n": pa.array([], pa.int64()), "best": pa.array([], pa.string())})
    count = frame["n"].to_numpy()
    codes = letters(own["word"], length)
    x = points(codes)
    tree, signs = Tree(x, LEAF), signature(x)
    ends: list[np.ndarray] = []  # of each pair its two rows of the frame
    for kind in (0, 1, 2):
        first, n = int(np.searchsorted(kinds, kind)), int((kinds == kind).sum())
        if not n:
            continue
        q_codes = codes if kind == 0 else letters(frame["word"].slice(first, n), length - (kind == 2))
        q = x if kind == 0 else points(q_codes)
        for a, b in _pairs(tree, signs, codes, signs if kind == 0 else signature(q), q_codes, q, kind == 2, kind == 0):
            ends.append(np.stack([a + first, b]))
    pairs = np.concatenate(ends, axis=1) if ends else np.zeros((2, 0), np.int64)
    me, other = np.concatenate([pairs[0], pairs[1]]), np.concatenate([pairs[1], pairs[0]])
    # One row a word: its neighbours, and the one of the largest n (ties: the least word).
    text = frame["word"].combine_chunks() if isinstance(frame["word"], pa.ChunkedArray) else frame["word"]
    names = np.array(text.to_pylist(), dtype=object)
    alphabetic = np.empty(len(names), np.int64)
    alphabetic[np.argsort(names, kind="stable")] = np.arange(len(names))
    order = np.lexsort((alphabetic[other], -count[other], me))
    me, other = me[order], other[order]
    heads = np.flatnonzero(np.r_[True, me[1:] != me[:-1]]) if len(me) else np.zeros(0, np.int64)
    near = np.diff(np.r_[heads, len(me)])
    return pa.table({"word": pa.array(names[me[heads]], pa.string()), "n": pa.array(count[me[heads]], pa.int64()), "n_near": pa.array(near, pa.int64()),
                     "best_n": pa.array(count[other[heads]], pa.int64()), "best": pa.array(names[other[heads]], pa.string())})


# --------------------------------------------------------------- all boxes

def boxes(table: DataFrame, size: int = BOX, sample: int = SAMPLE) -> dict[int, Tree]:
    """A tree for each length whose words exceed one box, from ``sample`` words at
    most, those of the least hash. The counts of words by length are one row a length."""
    total = table.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n")).where(F.col("n") > size).collect()
    many = {r["length"]: r["n"] for r in total}
    if not many:
        return {}
    drawn = table.where(F.length("word").isin(list(many))).orderBy(F.xxhash64("word"), "word").limit(sample).toArrow()["word"].to_pylist()
    trees = {}
    for length, n in many.items():
        mine = [w for w in drawn if len(w) == length]
        if mine:
            trees[length] = Tree(points(letters(pa.array(mine, pa.string()), length)), size * len(mine) / n)
    return trees


ROUTED = "length int, box int, asks int, word string, n long"


def _route(trees: dict[int, Tree]):
    """Each word to its own box and to the boxes that it asks."""
    def run(batches):
        for batch in batches:
            text, n = np.array(batch.column("word").to_pylist(), dtype=object), batch.column("n").to_numpy()
            size = np.array([len(w) for w in text], np.int32)
            out = {"length": [], "box": [], "asks": [], "row": []}

            def give(length, box, asks, rows):
                out["length"].append(np.full(len(rows), length, np.int32))
                out["box"].append(np.broadcast_to(np.asarray(box, np.int32), len(rows)))
                out["asks"].append(np.full(len(rows), asks, np.int32))
                out["row"].append(rows)

            for length in np.unique(size).tolist():
                rows = np.flatnonzero(size == length)
                x = points(letters(pa.array(text[rows], pa.string()), length))
                home = np.zeros(len(rows), np.int32)
                if length in trees:
                    for box, _, asks in trees[length].search(x, 0, 0):  # one leaf a point
                        home[asks] = box
                    for box, _, asks in trees[length].search(x, 1, 1):
                        asks = asks[home[asks] < box]
                        give(length, box, 1, rows[asks])
                give(length, home, 0, rows)
                if length + 1 in trees:
                    for box, _, asks in trees[length + 1].search(x, 1, 0):
                        give(length + 1, box, 2, rows[asks])
                else:
                    give(length + 1, 0, 2, rows)
            row = np.concatenate(out["row"]) if out["row"] else np.zeros(0, np.int64)
            for i in range(0, len(row), 1 << 16):
                cut = slice(i, i + (1 << 16))
                whole = [np.concatenate(out[k])[cut] for k in ("length", "box", "asks")]
                yield pa.RecordBatch.from_arrays([*map(pa.array, whole), pa.array(text[row[cut]], pa.string()), pa.array(n[row[cut]], pa.int64())],
                                                 names=["length", "box", "asks", "word", "n"])
    return run


def near_words(table: DataFrame, size: int = BOX, sample: int = SAMPLE) -> DataFrame:
    """(word, n, n_near, best, best_n) of each word of a (word, n) table that has near
    words; words are of the letters of ``LETTERS`` without A-Z, each one once. The table is read twice."""
    routed = table.mapInArrow(_route(boxes(table, size, sample)), ROUTED)
    found = routed.groupBy("length", "box").applyInArrow(_box, FOUND)
    # The neighbour of the largest n, of those the least word: words sort by code points.
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    merged = found.groupBy("word").agg(F.first("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    return merged.select("word", "n", "n_near", F.col("b.word").alias("best"), (-F.col("b.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a (word, form) table: forms followed to the last one. Each
    step at least doubles n, so no chain is a circle or longer than 63. Every round
    follows twice as many steps and is written to the shared folder."""
    spark = forms.sparkSession
    read = lambda path: spark.read.schema("word string, root string").parquet(path)
    now = staged_path(forms.select("word", F.col("form").alias("root")))
    while True:
        a = read(now)
        further = a.alias("a").join(a.alias("b"), F.col("a.root") == F.col("b.word"), "left")
        after = staged_path(further.select("a.word", F.coalesce("b.root", "a.root").alias("root")))
        moved = not a.join(read(after), ["word", "root"], "left_anti").isEmpty()
        unstage(spark, now)
        now = after
        if not moved:
            return read(now)


def variants(docs: DataFrame, ratio: int = 2, size: int = BOX, sample: int = SAMPLE, **kept) -> DataFrame:
    """One row a word: word, n, n_near, form (the near word of largest n, ties: the
    least, if that n is ``ratio`` times the word's at least), form_n, root."""
    table = stage(words(docs, **kept))
    near = stage(near_words(table, size, sample))
    form: Column = F.col("best_n") >= ratio * F.col("n")
    chosen = near.select("word", "n_near", F.when(form, F.col("best")).alias("form"), F.when(form, F.col("best_n")).alias("form_n"))
    root = roots(chosen.where("form IS NOT NULL"))
    return table.join(chosen, "word", "left").join(root, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
