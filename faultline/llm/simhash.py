"""SimHash near-duplicates through an inverted index of positional bytes.

A fingerprint has eight bytes. Two fingerprints that differ in at most k bits
(k < 8) share at least 8 - k bytes in place. The index posts each distinct
fingerprint under combinations of its positional bytes, chosen so that two
fingerprints with the guaranteed number of shared bytes meet in at least one
list (single bytes would put a 256th of all fingerprints in each list). Within
a list the shared positional bytes of each pair are tallied, pairs below the
guaranteed minimum go, and the rest is verified by the bit distance.

Exact copies and equal fingerprints are one node. A list longer than ``LIST``
is split into sublists that meet in pairs, so no task holds more than two
sublists. Lists answer with a spanning forest of their links, never with all
pairs: links are only needed up to connectivity.

Defined results: a null or empty text, or one without words, has fingerprint
zero and links like any other. Repeated rows each get their row. A component's
id is its smallest doc_id (nulls aside; null if it has no other). Columns of the
input beside doc_id and text are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import NOT_SPACE, blocks, stage, text_bytes, word_spans
from faultline.llm.components import components

SHINGLE, DISTANCE, SEED = 3, 3, 42
#: Fingerprints of a sublist: a task compares two sublists at a time.
LIST = 2048

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# ---------------------------------------------------------- fingerprints

def fingerprints_of(offsets: np.ndarray, data: np.ndarray, shingle: int) -> np.ndarray:
    """One fingerprint a text."""
    data = _LOWER[data]
    starts, ends, first = word_spans(offsets, data, NOT_SPACE)
    out = np.zeros(len(offsets) - 1, np.uint64)
    raw, digest = data.tobytes(), xxhash.xxh64_intdigest
    # Where all words are one space apart, a shingle is a slice of the text as it is.
    for d in range(len(out)):
        a, b = int(first[d]), int(first[d + 1])
        n = b - a
        if n == 0:
            continue
        s, e = starts[a:b], ends[a:b]
        k = min(shingle, n)
        plain = bool(((s[1:] - e[:-1]) == 1).all()) and not (data[e[:-1]] != 32).any()
        if plain:
            hashes = [digest(raw[i:j], SEED) for i, j in zip(s[: n - k + 1].tolist(), e[k - 1:].tolist())]
        else:
            words = [raw[i:j] for i, j in zip(s.tolist(), e.tolist())]
            hashes = [digest(b" ".join(words[i: i + k]), SEED) for i in range(n - k + 1)]
        h = np.array(hashes, np.uint64)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 8192):
            bits = np.unpackbits(h[at: at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
        out[d] = np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]
    return out


def _fingerprint_batches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_bytes(batch.column("text"))
            prints = [fingerprints_of(offsets[a: b + 1] - offsets[a], data[offsets[a]: offsets[b]], shingle)
                      for a, b in blocks(offsets)]
            prints = np.concatenate([np.zeros(0, np.uint64), *prints]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints)], names=["doc_id", "fp"])
    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _fingerprint_batches(shingle), f"doc_id {kind}, fp long")


# ----------------------------------------------------------------- index

def posting_positions(distance: int) -> list[tuple[int, ...]]:
    """Combinations of byte positions such that any 8 - distance positions hold
    one of them: the positions are split in two halves, and one half holds at
    least half of the shared ones."""
    if not 0 <= distance < 8:
        raise ValueError("a bit distance from 0 to 7 leaves a positional byte in common")
    k = (8 - distance + 1) // 2
    return [c for half in (range(4), range(4, 8)) for c in combinations(half, k)]


def _list_key(fp, positions: tuple[int, ...], which: int):
    mask = sum(0xFF << (8 * p) for p in positions)
    signed = mask - (1 << 64) if mask >= 1 << 63 else mask
    return F.xxhash64(F.lit(which), fp.bitwiseAND(F.lit(signed).cast("long")))


def postings(nodes: DataFrame, distance: int) -> DataFrame:
    """(list, fp): lists hold fingerprints with the same bytes at some positions."""
    keys = F.array(*[_list_key(F.col("fp"), c, i) for i, c in enumerate(posting_positions(distance))])
    return nodes.select("fp", F.explode(keys).alias("list"))


_ONES = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def _distance(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x) if hasattr(np, "bitwise_count") else _ONES[x.view(np.uint16).reshape(*x.shape, 4)].sum(-1)


def linked(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Tally of shared positional bytes, count filter, then the bit distance."""
    x = a ^ b
    shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    out = shared >= 8 - distance
    out[out] = _distance(x[out]) <= distance
    return out


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect what the links of one list connect: found breadth first,
    each newly reached fingerprint against all that are not yet reached."""
    left, out = fps.copy(), []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            step = max(1, (1 << 20) // len(left))
            here, front = front[:step], front[step:]
            x = here[:, None] ^ left[None, :]
            near = linked_matrix(x, distance)
            reached = near.any(axis=0)
            if reached.any():
                by = near.argmax(axis=0)[reached]
                out += zip(here[by].tolist(), left[reached].tolist())
                front = np.concatenate([front, left[reached]])
                left = left[~reached]
    return out


def linked_matrix(x: np.ndarray, distance: int) -> np.ndarray:
    """``linked`` for a matrix of differences; the tally is over each cell's bytes."""
    near = _distance(x) <= distance
    if near.any():
        shared = (x[near].view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        near[near] = shared >= 8 - distance
    return near


def _link_batches(distance: int):
    """Rows (list, fp) in order of list: each list is compared once it is whole."""
    def links(lists: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1], True])
        size = np.diff(cut)
        found = [np.zeros((0, 2), np.uint64)]
        # Lists of up to 16: all lists at once, by distance in the list.
        length = np.repeat(size, size)
        for gap in range(1, 16):
            i = np.flatnonzero((length[:-gap] <= 16) & (lists[gap:] == lists[:-gap])) if gap < len(lists) else []
            if len(i) == 0:
                break
            a, b = fps[i], fps[i + gap]
            ok = linked(a, b, distance)
            found.append(np.stack([a[ok], b[ok]], axis=1))
        for c in np.flatnonzero(size > 16):
            pairs = _forest(np.unique(fps[cut[c]: cut[c + 1]]), distance)
            if pairs:
                found.append(np.array(pairs, np.uint64))
        both = np.concatenate(found)
        return both[:, 0].view(np.int64) if len(both) else np.zeros(0, np.int64), both[:, 1].view(np.int64) if len(both) else np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.uint64)]

        def answer(lists, fps):
            a, b = links(lists, fps) if len(lists) else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a)), pa.array(np.ascontiguousarray(b))], names=["a", "b"])
        for batch in batches:
            lists = np.concatenate([held[0], batch.column("list").to_numpy(zero_copy_only=False)])
            fps = np.concatenate([held[1], batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(lists):
                continue
            cut = int(np.searchsorted(lists, lists[-1]))  # the last list may go on in the next batch
            held = [lists[cut:], fps[cut:]]
            if cut:
                yield answer(lists[:cut], fps[:cut])
        yield answer(*held)
    return run


def links(nodes: DataFrame, distance: int = DISTANCE, size: int = LIST) -> DataFrame:
    """(a, b) of distinct fingerprints within the distance, enough to connect all that are."""
    posted = postings(nodes, distance)
    lengths = posted.groupBy("list").agg(F.count("*").alias("n")).where("n > 1")
    kept = posted.join(lengths, "list")
    parts = F.ceil(F.col("n") / size).cast("long")
    part = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts"))
    # A long list's sublist i meets each sublist j: (min, max) names the meeting.
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    short = kept.where(F.col("n") <= size).select("list", "fp")
    long = (kept.where(F.col("n") > size).withColumn("parts", parts).withColumn("i", part)
            .select("list", "fp", "i", "parts", other.alias("j")).where((F.col("i") != F.col("j")) | (F.col("parts") == 1))
            .select(F.xxhash64("list", F.least("i", "j"), F.greatest("i", "j")).alias("list"), "fp"))
    meet = short.union(long).repartition("list").sortWithinPartitions("list")
    return meet.mapInArrow(_link_batches(distance), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    spark = docs.sparkSession
    prints = stage(fingerprints(docs, shingle))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(prints.select("fp").distinct(), distance))
    whole = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = whole.groupBy("root").agg(F.min("first").alias("component_id"))
    member = whole.select("fp", "root").join(firsts, "root").select("fp", "component_id")
    return prints.join(member, "fp").select("doc_id", "fp", "component_id")
