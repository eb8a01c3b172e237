"""Exact removal of byte strings of a given length that occur more than once.

The texts' suffixes are sorted in buckets: a suffix goes to the bucket of its
anchor, the least hash among the short byte strings of its first ``length``
bytes. Equal strings have equal anchors at equal distances, so a bucket holds
all suffixes that can tie over ``length`` bytes, and buckets whose anchor occurs
once need no sorting at all. A task sorts one run of buckets at a time, of a
bounded number of bytes: first by eight bytes, and long ties by the ranks of a
difference-cover sample (residues 0, 1, 3 modulo 7: any two suffixes have a
common shift below 7 at which both are in the sample). Sample ranks are made by
doubling from 7 to 224 bytes and cover the rest of ``length`` in two overlapping
strides. Equal neighbours over ``length`` bytes are repeats.

A bucket larger than a task's bound goes back sliced by the distance of suffix
and anchor, each slice keyed by the bytes that all its suffixes share. Slices that
share these bytes but differ around them may still be too many for a task: those go
back once more, one suffix to a slice, so only true copies meet. Before slices are
sent, a task dedupes those it gathers, so a string held by any share of the texts is
one row for each ``GATHER_BYTES`` of slices, not one a text.

Texts that are wholly equal are looked at once: with ``length`` bytes or more
each byte of a copy is in a string that starts in the other copy too.

Defined results: a null text is an empty one; a text shorter than ``length``
keeps all bytes. Repeated rows are copies of each other. Matches never cross
texts, and strings are judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import blocks, mixed, stage, text_bytes, text_id, window_minima
from faultline.llm.exchange import shared_items, starts_of

LENGTH, GRAM = 400, 32
#: Bytes that a task sorts together, and of a bucket before it is sliced.
RUN_BYTES, BUCKET_BYTES = 1 << 20, 32 << 20
#: Bytes of bucket rows that a task gathers to find equal ones.
GATHER_BYTES = 12 << 20
#: Known spans that a task holds before it sends them.
KNOWN_ROWS = 10_000
SLICES = 8

_COVER, _PERIOD = (0, 1, 3), 7
_BASE = 0x9E3779B97F4A7C15 | 1


def byte_grams(data: np.ndarray, k: int = GRAM) -> np.ndarray:
    """Hashes of each k bytes (k a power of two), by doubling."""
    h, have = data.astype(np.uint64) + np.uint64(1), 1
    while have < k:
        if len(h) <= have:
            return np.zeros(0, np.uint64)
        h = h[:-have] * np.uint64(pow(_BASE, have, 1 << 64)) + h[have:]
        have *= 2
    return mixed(h)


def anchors(offsets: np.ndarray, data: np.ndarray, length: int):
    """Of each text with ``length`` bytes or more: places of anchors (from the
    block's start), first and last start of the strings that have them, and the text."""
    grams = byte_grams(data)
    least = window_minima(grams, length - GRAM + 1)
    out = []
    for d in np.flatnonzero(np.diff(offsets) >= length):
        mine = least[offsets[d]: offsets[d + 1] - length + 1]
        cut = starts_of(mine)
        ends = np.append(cut[1:], len(mine)) - 1
        out.append((mine[cut], cut + offsets[d], ends + offsets[d], np.full(len(cut), d)))
    if not out:
        return grams, *(np.zeros(0, np.int64),) * 4
    return grams, *(np.concatenate([x[i] for x in out]) for i in range(4))


def _key_rows(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(text_bytes(column)[1].tobytes(), np.uint8).reshape(-1, width)


def _anchor_items(length: int):
    def run(batch: pa.RecordBatch):
        offsets, data = text_bytes(batch.column("text"))
        keys = _key_rows(batch.column("short"), 8)
        for a, b in blocks(offsets):
            off = offsets[a: b + 1] - offsets[a]
            grams, place, _, _, text = anchors(off, data[offsets[a]: offsets[b]], length)
            yield keys[a:b], grams[place], text, place - off[text]
    return run


# ---------------------------------------------------------- bucket rows

SEGMENT = "bucket long, id binary, start long, anchor int, several boolean, bytes binary"


def _segments(length: int):
    """Texts with their shared anchors to one row a (text, anchor): the bytes of
    all strings that have the anchor. Equal rows that a task gathers become one,
    which is marked; of the others only the merged spans go on, dealt by text: their
    bytes are empty, and the anchor is minus the span's length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, seen, known, size = [], {}, {}, 0

        def flush():
            rows = [(r[3], r[0], r[1], r[2], r[4], r[5]) for r in gathered]
            rows += [(int.from_bytes(i[:8], "little", signed=True), i, a, a - b, True, b"") for i, spans in known.items() for a, b in merged(spans)]
            for at in range(0, len(rows), 10_000):
                some = list(zip(*rows[at: at + 10_000]))
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(some, kinds)],
                                                 names=["bucket", "id", "start", "anchor", "several", "bytes"])

        for batch in batches:
            offsets, data = text_bytes(batch.column("text"))
            ids, answers = batch.column("id"), batch.column("answers")
            for a, b in blocks(offsets):
                off = offsets[a: b + 1] - offsets[a]
                raw = data[offsets[a]: offsets[b]]
                grams, place, lo, hi, text = anchors(off, raw, length)
                wanted = [np.concatenate([np.frombuffer(x["hashes"], np.uint64) for x in answers[i].as_py()]) for i in range(a, b)]
                chosen = np.zeros(len(place), bool)
                for d in range(b - a):
                    s = slice(*np.searchsorted(text, [d, d + 1]))
                    chosen[s] = np.isin(grams[place[s]], wanted[d])
                lo, hi, place, text = lo[chosen], hi[chosen], place[chosen], text[chosen]
                names = [x.as_py() for x in ids.slice(a, b - a)]
                body = raw.tobytes()
                rows = []
                for p, x, y, t, g in zip(place.tolist(), lo.tolist(), hi.tolist(), text.tolist(), grams[place].view(np.int64).tolist()):
                    part = body[x: y + length]
                    start = x - int(off[t])
                    first = seen.get(part)
                    if first and first[2] == p - x:
                        if (first[0], first[1]) != (names[t], start):
                            first[4] = True
                            known.setdefault(names[t], []).append({"start": start, "end": start + len(part)})
                        continue
                    row = seen[part] = [names[t], start, p - x, g, False, part]
                    rows.append(row)
                gathered += rows
                size += sum(len(r[5]) for r in rows)
                if size >= GATHER_BYTES:
                    yield from flush()
                    gathered, seen, known, size = [], {}, {}, 0
        yield from flush()
    return run


def ranks(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of one or two columns of whole numbers below 2**32."""
    key = keys[0].astype(np.uint64) if len(keys) == 1 else (keys[0].astype(np.uint64) << np.uint64(32)) | keys[1].astype(np.uint64)
    order = np.argsort(key)
    s = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]])) if len(s) else 0
    return out


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, as a number (zeros follow the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data)]).view(">u8")[:, 0].astype(np.uint64)


def repeated_starts(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Flags of the suffix starts whose first ``length`` bytes are those of another start."""
    n, out = len(data), np.zeros(len(starts), bool)
    if length < 32 or len(starts) < 2:
        text = [data[i: i + length].tobytes() for i in starts.tolist()]
        _, back, count = np.unique(np.array(text, object), return_inverse=True, return_counts=True) if text else ([], [], [])
        return count[back] > 1 if text else out
    head = eight_bytes(data)
    in_cover = np.isin(np.arange(n) % _PERIOD, _COVER)
    sample = np.flatnonzero(in_cover)
    number = np.cumsum(in_cover) - 1  # of a sampled place
    rank, have = ranks_wide(head[sample] >> np.uint64(8)), _PERIOD
    reach = (length - 8) // _PERIOD * _PERIOD  # bytes from the shift that sample ranks must cover
    while have < reach:
        step = min(have, reach - have)  # a multiple of the period, so the place after it is sampled too
        after = np.minimum(sample + step, n - 1)
        second = np.where(sample + step < n, rank[number[after]] + 1, 0)
        rank, have = ranks(rank, second), have + step
    first, last = ranks_wide(np.concatenate([head[starts], head[starts + length - 8]])).reshape(2, -1)
    ends = ranks(first, last)
    if reach < length - 8:  # up to six bytes are between the sample's reach and the last eight
        ends = ranks(ends, ranks_wide(head[starts + length - 14]))
    for shift in range(_PERIOD):
        mine = np.flatnonzero(in_cover[starts + shift])
        key = (ends[mine].astype(np.uint64) << np.uint64(32)) | rank[number[starts[mine] + shift]].astype(np.uint64)
        order = np.argsort(key)
        s = key[order]
        tie = np.concatenate([[False], s[1:] == s[:-1]]) if len(s) else np.zeros(0, bool)
        tie[:-1] |= tie[1:]
        out[mine[order[tie]]] = True
    return out


def ranks_wide(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    s = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]])) if len(s) else 0
    return out


# One result row: a run of repeated strings (bytes is null), or a slice of an oversized bucket.
FOUND = "id binary, start long, end long, bucket long, anchor int, several boolean, bytes binary"
_FOUND = ["id", "start", "end", "bucket", "anchor", "several", "bytes"]


class Run:
    """Buckets that are sorted together."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        self.size += len(row[4])

    def settle(self, length: int) -> Iterator[pa.RecordBatch]:
        rows = {(r[0], r[1]): r for r in self.rows}  # a row that came twice is one
        rows = list(rows.values())
        if not rows:
            return
        data = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
        size = np.array([len(r[4]) for r in rows])
        base = np.cumsum(size) - size
        count = size - length + 1
        starts = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(base, count)
        # A row that stands for several equal ones is repeated throughout.
        hit = repeated_starts(data, starts, length) | np.repeat(np.array([r[3] for r in rows]), count)
        owner = np.repeat(np.arange(len(rows)), count)
        place = starts - base[owner]
        on = np.flatnonzero(hit)
        if not len(on):
            return
        new = np.concatenate([[True], (owner[on][1:] != owner[on][:-1]) | (place[on][1:] - place[on][:-1] > length)])
        first = on[new]
        last = on[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(on) - 1]])]
        r = owner[first]
        begin = np.array([x[1] for x in rows])[r]
        yield found([rows[i][0] for i in r.tolist()], begin + place[first], begin + place[last] + length)


def found(ids: list, start, end) -> pa.RecordBatch:
    n = len(ids)
    none = [pa.nulls(n, t) for t in (pa.int64(), pa.int32(), pa.bool_(), pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), *none], names=_FOUND)


def sliced(row: tuple, length: int, step: int) -> list[tuple]:
    """A bucket row cut by the distance of string and anchor, ``step`` distances to a
    slice; a slice's bucket is named by the bytes that all its strings share."""
    id_, start, anchor, several, data, bucket = row
    out, nearest = [], max(0, anchor - (len(data) - length))
    for low in range(nearest // step * step, min(anchor, length - GRAM) + 1, step):
        high = min(low + step - 1, length - GRAM)
        a, b = max(0, anchor - high), min(len(data) - length, anchor - low)  # starts of the slice's strings
        core = data[anchor - low: anchor - high + length]
        name = hashlib.blake2b(core + (low // step).to_bytes(2, "little") + bucket.to_bytes(8, "little", signed=True), digest_size=8).digest()
        out.append((id_, start + a, anchor - a, several, data[a: b + length], int.from_bytes(name, "little", signed=True)))
    return out


class Gather:
    """Slices that a task is about to send. Of equal ones that it gathers one goes on,
    marked; of the others the spans are known to be repeated."""

    def __init__(self):
        self.rows: dict[tuple, list] = {}
        self.known: list[tuple] = []
        self.size = 0

    def add(self, row: tuple) -> None:
        id_, start, anchor, several, data, bucket = row
        first = self.rows.get((bucket, anchor, data))
        if first is None:
            self.rows[bucket, anchor, data] = list(row)
            self.size += len(data)
        elif (first[0], first[1]) == (id_, start):  # a row that came twice is one
            first[3] |= several
        else:
            first[3] = True
            self.known.append((id_, start, start + len(data)))

    def full(self) -> bool:
        return self.size >= GATHER_BYTES or len(self.known) >= KNOWN_ROWS

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.known:
            yield found(*map(list, zip(*self.known)))
        rows = list(self.rows.values())
        for at in range(0, len(rows), 10_000):
            ids, start, anchor, several, data, bucket = zip(*rows[at: at + 10_000])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.binary()), pa.array(start, pa.int64()), pa.nulls(len(ids), pa.int64()), pa.array(bucket, pa.int64()),
                 pa.array(anchor, pa.int32()), pa.array(several, pa.bool_()), pa.array(data, pa.binary())], names=_FOUND)
        self.__init__()


def _sort(length: int, bound: int | None, step: int = 1):
    """Rows in order of bucket to runs of repeated strings; buckets over ``bound`` bytes
    are sliced by ``step`` distances."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, gather, bucket, held, size, over = Run(), Gather(), None, [], 0, False

        def slices(rows):
            for r in rows:
                for cut in sliced(r, length, step):
                    gather.add(cut)
                if gather.full():
                    yield from gather.flush()

        for batch in batches:
            known: list[tuple] = []
            for b, id_, start, anchor, several, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "id", "start", "anchor", "several", "bytes"))):
                if anchor < 0 and not data:
                    known.append((id_, start, start - anchor))
                    continue
                if b != bucket:
                    if over:
                        yield from slices(held)
                    elif len(held) > 1 or held and held[0][3]:
                        for r in held:
                            ready.add((r[0], r[1], r[2], r[3], r[4]))
                        if ready.size >= RUN_BYTES:
                            yield from ready.settle(length)
                            ready = Run()
                    bucket, held, size, over = b, [], 0, False
                held.append((id_, start, anchor, several, data, b))
                size += len(data)
                if bound is not None and (size > bound or over):
                    over = True
                    yield from slices(held)
                    held = []
            if known:
                yield found(*map(list, zip(*known)))
        if over:
            yield from slices(held)
        elif len(held) > 1 or held and held[0][3]:
            for r in held:
                ready.add((r[0], r[1], r[2], r[3], r[4]))
        yield from gather.flush()
        yield from ready.settle(length)
    return run


# -------------------------------------------------------------- operator

def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = text_bytes(batch.column("text"))
        body = data.tobytes()
        digest = [hashlib.sha256(body[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(np.diff(offsets)), pa.array(digest)],
                                         names=["row", "id", "n_bytes", "sha256"])


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = text_bytes(batch.column("text"))
        body, rows = data.tobytes(), []
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            text, cuts = body[offsets[i]: offsets[i + 1]], merged(spans)
            kept, at = [], 0
            for a, b in cuts:
                kept.append(text[at:a])
                at = b
            kept.append(text[at:])
            rows.append((sum(b - a for a, b in cuts), len(cuts), hashlib.sha256(b"".join(kept)).hexdigest(), [{"start": a, "end": b} for a, b in cuts]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows]),
             pa.array([r[3] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            names=["id", "n_removed", "n_spans", "sha256", "spans"])


def repeated_bytes(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, spans) of each row; spans
    are the removed (start, end) bytes."""
    if length < 2 * GRAM:
        raise ValueError(f"strings of {2 * GRAM} bytes or more")
    texts = docs.select(F.col(f"`{key}`").alias("row"), text_id(F.col("text")).alias("id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    whole = stage(texts.mapInArrow(_whole, f"row {kind}, id binary, n_bytes long, sha256 string"))
    # One row stands for its copies; equal keys or nulls may leave more, which count once below.
    copies = whole.groupBy("id").agg(F.count("*").alias("copies"), F.min("row").alias("least"))
    long = texts.where(F.octet_length("text") >= length)
    short = F.substring("id", 1, 8)
    answers = shared_items(long.select(short.alias("short"), "text"), _anchor_items(length), 8, twice=True)
    standing = copies.select(short.alias("text_key"), "id", "least").join(answers, "text_key")
    asked = stage(long.alias("t").join(standing.alias("s"), (F.col("t.id") == F.col("s.id")) & F.col("t.row").eqNullSafe(F.col("s.least")))
                  .select("t.id", "t.text", F.transform("s.answers", lambda x: F.struct(x["hashes"].alias("hashes"))).alias("answers")))
    ordered = lambda rows: rows.repartition("bucket").sortWithinPartitions("bucket")
    first = stage(ordered(asked.mapInArrow(_segments(length), SEGMENT)).mapInArrow(_sort(length, bucket_bytes, -(-(length - GRAM + 1) // SLICES)), FOUND))
    slices = lambda rows: rows.where("bytes IS NOT NULL").select("bucket", "id", "start", "anchor", "several", "bytes")
    second = stage(ordered(slices(first)).mapInArrow(_sort(length, bucket_bytes), FOUND))
    third = ordered(slices(second)).mapInArrow(_sort(length, None), FOUND)
    ends = lambda rows: rows.where("bytes IS NULL").select("id", "start", "end")
    spans = (ends(first).union(ends(second)).union(ends(third))
             .groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    one_text = asked.select("id", "text").join(spans, "id").mapInArrow(
        _cut, "id binary, n_removed long, n_spans long, sha256 string, spans array<struct<start:long,end:long>>")
    cut = one_text.dropDuplicates(["id"]).withColumnRenamed("sha256", "cut_sha256")
    out = whole.join(copies.select("id", "copies").join(cut, "id", "left"), "id")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    zero = F.lit(0).cast("long")
    all_of_it = F.array(F.struct(zero.alias("start"), F.col("n_bytes").alias("end")))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return out.select(
        F.col("row").alias(key), "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(gone, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("cut_sha256", "sha256")).alias("kept_sha256"),
        F.when(gone, all_of_it).otherwise(F.coalesce("spans", none)).alias("spans"))
