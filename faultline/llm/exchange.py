"""Which texts share a hashed item: requests and answers in two small shuffles.

Every task dedupes the items of its own texts first. Of the texts of a task
that hold an item, one (the least in order) asks; the others are answered on the
spot, so an item of a third of all texts is one request a task. Where the order is
wanted (``places``), texts of the least one's order ask too: whether they are later
depends on the texts of other tasks, as it does for the least. Requests travel
as packed arrays, dealt by the item's hash; answers travel as packed arrays,
dealt by text, and are put together there. An item is shared if at least two texts hold it (or, on demand, one text
twice), and a text is later if a smaller one in order holds the item too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items that a task gathers before it sends them.
FLUSH = 2_000_000
#: Texts of a batch of answers.
TEXTS = 5000

_WIRE = "bucket int, asks boolean, texts binary, counts binary, hashes binary, places binary, flags binary"
_RETURN = "home int, texts binary, counts binary, hashes binary, places binary, flags binary"
ANSWER = "text_key binary, hashes binary, places binary, later binary"


def packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column whose rows are ``counts`` consecutive values each."""
    values = np.ascontiguousarray(values)
    ends = np.concatenate([[0], np.cumsum(counts)]) * (values.dtype.itemsize * (values.shape[1] if values.ndim > 1 else 1))
    if ends[-1] >= 1 << 31:
        raise ValueError("an Arrow batch of this size needs smaller batches")
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)])


def starts_of(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)


class Gathered:
    """Items of some texts: hash, number of the text, place in it. ``keys`` names
    the texts (rows of bytes, the last eight the order as a big-endian long)."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.keys: list[np.ndarray] = []
        self.n_items = self.n_texts = 0

    def add(self, keys: np.ndarray, hashes: np.ndarray, text: np.ndarray, place: np.ndarray) -> None:
        self.parts.append((hashes, text + self.n_texts, place.astype(np.uint32)))
        self.keys.append(keys)
        self.n_items += len(hashes)
        self.n_texts += len(keys)

    def arrays(self):
        h, t, p = (np.concatenate([x[i] for x in self.parts]) for i in range(3))
        return np.concatenate(self.keys), h, t, p


def order_of(keys: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(keys[:, -8:]).view(">i8")[:, 0].astype(np.int64) if keys.shape[1] > 8 else np.zeros(len(keys), np.int64)


def _settled(keys, h, t, p, twice: bool, places: bool):
    """Items in order of hash, then order, key and text; with them the group
    number, the first text of the group and whether several hold it."""
    rank = np.empty(len(keys), np.int64)
    whole = np.ascontiguousarray(keys).view(f"V{keys.shape[1]}")[:, 0]
    _, same = np.unique(whole, return_inverse=True)  # rows with one key are one text
    by = np.lexsort((same, order_of(keys)))
    rank[by] = np.cumsum(np.concatenate([[0], same[by][1:] != same[by][:-1]])) if len(by) else 0
    r = rank[t]
    at = np.lexsort((p, r, h))
    h, t, p, r = h[at], t[at], p[at], r[at]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])]) if len(h) else np.zeros(0, bool)
    if not places:
        extra = np.zeros(len(h), bool)
        if twice and len(h):  # the same item at two places of one text
            again = ~new & np.concatenate([[False], p[1:] != p[:-1]])
            extra = np.zeros(new.sum(), bool)
            np.logical_or.at(extra, (np.cumsum(new) - 1)[again], True)
        else:
            extra = extra[new]
        h, t, p, r = h[new], t[new], p[new], r[new]
    else:
        keep = new | np.concatenate([[True], p[1:] != p[:-1]]) if len(h) else new
        h, t, p, r, extra = h[keep], t[keep], p[keep], r[keep], np.zeros(int(keep.sum()), bool)
    first = starts_of(h)
    size = np.diff(np.concatenate([first, [len(h)]]))
    lead = np.repeat(r[first], size) if len(h) else r
    several = np.repeat(np.logical_or.reduceat((r != lead) | extra, first), size) if len(h) else extra
    return h, t, p, r == lead, several, first, size


def _rows(keys, t, h, p, flag, bucket) -> dict[str, pa.Array]:
    """Packed columns, one row a bucket: texts with their numbers of items, and the items."""
    at = np.lexsort((t, bucket))
    bucket, t, h, flag = bucket[at], t[at], h[at], flag[at]
    pair = starts_of(bucket.astype(np.int64) * (len(keys) + 1) + t)
    per_text = np.diff(np.concatenate([pair, [len(h)]])).astype(np.uint32)
    row = starts_of(bucket)
    items = np.diff(np.concatenate([row, [len(h)]]))
    texts = np.diff(np.searchsorted(pair, np.concatenate([row, [len(h)]])))
    return {"bucket": pa.array(bucket[row], pa.int32()), "texts": packed(keys[t[pair]], texts), "counts": packed(per_text, texts),
            "hashes": packed(h, items), "places": packed(p[at], items) if p is not None else pa.array([b""] * len(row), pa.binary()),
            "flags": packed(flag.astype(np.uint8), items)}


def _home(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where the answers of each text are put together."""
    return (np.ascontiguousarray(keys[:, :8]).view("<u8")[:, 0] % np.uint64(buckets)).astype(np.int32)


def _send(items: Callable, buckets: int, twice: bool, places: bool):
    def flush(gathered: Gathered) -> Iterator[pa.RecordBatch]:
        if not gathered.n_items:
            return
        keys, h, t, p = gathered.arrays()
        h, t, p, lead, several, _, _ = _settled(keys, h, t, p, twice, places)
        order = order_of(keys)
        first = np.maximum.accumulate(np.where(np.concatenate([[True], h[1:] != h[:-1]]), np.arange(len(h)), 0))
        later = order[t] > order[t[first]]
        asking = lead | ~later if places else lead
        bucket = ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)
        for mine, flag, to, asks in ((asking, several, bucket, True), (~asking, later, _home(keys, buckets)[t], False)):
            if mine.any():
                rows = _rows(keys, t[mine], h[mine], p[mine] if places else None, flag[mine], to[mine])
                yield pa.RecordBatch.from_pydict({"bucket": rows.pop("bucket"), "asks": pa.array([asks] * len(rows["texts"])), **rows})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = Gathered()
        for batch in batches:
            for keys, hashes, text, place in items(batch):
                gathered.add(keys, hashes, text, place)
                if gathered.n_items >= FLUSH:
                    yield from flush(gathered)
                    gathered = Gathered()
        yield from flush(gathered)
    return run


def _column(batch: pa.RecordBatch, name: str, kind) -> np.ndarray:
    """All rows of a packed column, one after the other."""
    c = batch.column(name)
    off = np.frombuffer(c.buffers()[1], np.int32)[c.offset: c.offset + len(c) + 1]
    raw = np.frombuffer(c.buffers()[2] or b"", np.uint8)[off[0]: off[-1]] if len(c) else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), kind)


def _gathered(batches: list[pa.RecordBatch], width: int, places: bool):
    """(keys, text of each item, hashes, places, flags) of packed rows."""
    column = lambda name, kind: np.concatenate([_column(b, name, kind) for b in batches])
    keys, counts = column("texts", np.uint8).reshape(-1, width), column("counts", np.uint32)
    return keys, np.repeat(np.arange(len(keys)), counts), column("hashes", np.uint64), column("places", np.uint32) if places else None, column("flags", np.uint8)


def _answer(width: int, places: bool, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, names = [], ["home", "texts", "counts", "hashes", "places", "flags"]
        for batch in batches:
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            known = batch.filter(pa.array(~asks))
            if known.num_rows:
                yield pa.RecordBatch.from_arrays([known.column(n) for n in ("bucket", *names[1:])], names=names)
            batch = batch.filter(pa.array(asks))
            if batch.num_rows:
                asked.append(batch)
        if not asked:
            return
        keys, t, h, p, several = _gathered(asked, width, places)
        del asked
        order, whole = order_of(keys), np.ascontiguousarray(keys).view(f"V{width}")[:, 0]
        _, same = np.unique(whole, return_inverse=True)
        at = np.lexsort((order[t], h))
        hs, ts = h[at], t[at]
        first = starts_of(hs)
        size = np.diff(np.concatenate([first, [len(hs)]]))
        other = np.logical_or.reduceat((same[ts] != np.repeat(same[ts[first]], size)) | (several[at] > 0), first)
        shared, later = np.zeros(len(h), bool), np.zeros(len(h), bool)
        shared[at] = np.repeat(other, size)
        later[at] = order[ts] > np.repeat(order[ts[first]], size)
        if shared.any():
            rows = _rows(keys, t[shared], h[shared], p[shared] if places else None, later[shared], _home(keys, buckets)[t[shared]])
            yield pa.RecordBatch.from_arrays([rows[n] for n in ("bucket", *names[1:])], names=names)
    return run


def _together(width: int, places: bool):
    """One row a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        keys, t, h, p, later = _gathered(batches, width, places)
        del batches
        whole, same = np.unique(np.ascontiguousarray(keys).view(f"V{width}")[:, 0], return_inverse=True)
        keys = whole.view(np.uint8).reshape(-1, width)
        at = np.argsort(same[t], kind="stable")
        t, h, later, p = same[t][at], h[at], later[at], p[at] if places else None
        row = np.append(starts_of(t), len(t))
        for a in range(0, len(row) - 1, TEXTS):
            r = row[a: a + TEXTS + 1]
            s, items = slice(r[0], r[-1]), np.diff(r)
            yield pa.RecordBatch.from_arrays(
                [packed(keys[t[r[:-1]]], np.ones(len(items), np.int64)), packed(h[s], items),
                 packed(p[s], items) if places else pa.array([b""] * len(items), pa.binary()), packed(later[s], items)],
                names=["text_key", "hashes", "places", "later"])
    return run


def shared_items(texts: DataFrame, items: Callable, width: int, twice: bool = False, places: bool = False) -> DataFrame:
    """(text_key, answers): for each text with shared items an array of packed
    (hashes, places, later); ``later`` holds only with ``places``.

    ``items(batch)`` yields (keys, hashes, text numbers, places) for parts of an
    Arrow batch of ``texts``; keys have ``width`` bytes, the first eight of them spread evenly."""
    buckets = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = texts.mapInArrow(_send(items, buckets, twice, places), _WIRE).repartition(buckets, "bucket")
    returned = asked.mapInArrow(_answer(width, places, buckets), _RETURN).repartition(buckets, "home")
    answers = returned.mapInArrow(_together(width, places), ANSWER)
    return answers.select("text_key", F.array(F.struct("hashes", "places", "later")).alias("answers"))
