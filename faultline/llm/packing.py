"""Best-fit packing of tokenized documents, certified by lower bounds.

Documents become pieces of at most ``capacity`` tokens (only longer documents
are cut). Pieces are dealt evenly, by a hash of a written row number, to
partitions of about ``PIECES`` pieces, whatever the size of the table. Each
partition is packed best-fit decreasing, and dual feasible functions give a
lower bound of its bins: a partition whose bins equal the bound is certified.
The rest exchange: the documents of about ``EXCHANGE`` partitions with gaps are
pooled and packed anew, and the new packing is taken if it has fewer bins. Rounds
end when the bins reach the bound of the whole table, when no two gaps are left,
or after a round that saves no bin. ``certificate`` states the gap that remains.

Defined results: a null or empty text is a document of the end token alone.
Repeated rows are packed as separate documents. Ties in length go by row
number, so a lost task packs the same way again. An empty table packs to no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import stage, staged_path, unstage

CAPACITY = 2048
#: Pieces of a partition, and partitions that exchange in a round: together the most rows of one task.
PIECES, EXCHANGE = 8192, 4
#: Rounds of exchange; None goes on until a round saves no bin (0 packs without exchange, to compare).
ROUNDS: int | None = None
#: Partitions with gaps that are numbered together, to deal them in groups of ``EXCHANGE``.
SLOT = 4096
#: Words whose ids a Python worker remembers before it starts over.
WORDS = 1_000_000

PIECE_SCHEMA = "doc_id {}, piece int, start long, length long, ids_crc32 long"


# ---------------------------------------------------------------- tokens

class WordCache:
    """Token ids by word between ASCII white space. The vocabulary's normalizer
    and splitter never look past white space, so a text's ids are its words' ids in
    order. Words of Latin letters go straight to the library's BPE model, all
    others through the whole tokenizer."""

    #: Letters that NFC leaves as they are and whose lower case is one letter again.
    LATIN = re.compile(r"[a-zß-öø-ÿ]+")
    #: One piece of the splitter if it ends a word.
    TAIL = ".,!?;:*#$%&|"

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words: dict[bytes, bytes] = {}
        self.heads: dict[str, bytes] = {}
        self.bytes = byte_letters()

    def whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, word: str) -> bytes:
        head = word.rstrip(self.TAIL)
        low = head.lower()
        ids = self.heads.get(low)
        if ids is None:
            if not head or not self.LATIN.fullmatch(low) or not self.LATIN.fullmatch(head.swapcase().lower()):
                return self.whole(word)
            spelled = low if low.isascii() else "".join(map(self.bytes.__getitem__, low.encode()))
            ids = self.heads[low] = np.array([x.id for x in self.model.tokenize(spelled)], "<u4").tobytes()
        tail = word[len(head):]
        if not tail:
            return ids
        end = self.heads.get(tail)
        if end is None:
            end = self.heads[tail] = self.whole(tail)
        return ids + end

    def encode(self, text: bytes) -> bytes:
        words, known = text.split(), self.words
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            for w in set(words):
                if w not in known:
                    known[w] = self.learn(w.decode())
            out = b"".join([known[w] for w in words])
            if len(known) > WORDS:
                known.clear()
                self.heads.clear()
            return out


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: visible
    Latin-1 characters for themselves, the others from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = [""] * 256
    for b in seen:
        out[b] = chr(b)
    for n, b in enumerate(x for x in range(256) if x not in set(seen)):
        out[b] = chr(256 + n)
    return out


@lru_cache(maxsize=2)
def word_cache(path: str) -> WordCache:
    return WordCache(path)


def piece_batches(path: str, end_id: int, capacity: int):
    """Arrow batches of (doc_id, text) to one row a piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, end = word_cache(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                ids = cache.encode(text.as_py() or b"") + end
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k: k + 4 * capacity]
                    row.append(i)
                    piece.append(k // (4 * capacity))
                    start.append(k // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(
        piece_batches(tokenizer, end_id, capacity), PIECE_SCHEMA.format(kind))


# --------------------------------------------------------------- packing

def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each piece (ties in the given order)."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, used = 0, 0  # bit r: some bin has r tokens left
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = open_rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                open_rooms ^= 1 << room
        else:
            b, room, used = used, capacity, used + 1
        bins[i], offsets[i] = b, capacity - room
        left = room - n
        if left:
            free[left].append(b)
            open_rooms |= 1 << left
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def bound_of_counts(count: np.ndarray, capacity: int) -> int:
    """The best bound of dual feasible functions, from the pieces of each length:
    with x as a share of the bin, the identity, the step functions u_k(x) = x if
    (k + 1) x is whole, else floor((k + 1) x) / k, and the cuts U_e(x) = 0 below e,
    1 above 1 - e, else x."""
    if not count.any():
        return 0
    sizes = np.arange(capacity + 1, dtype=np.int64)
    up = lambda total, unit: -(-int(total) // unit)
    best = up((count * sizes).sum(), capacity)
    for k in range(1, 33):
        steps = (k + 1) * sizes
        best = max(best, up((count * np.where(steps % capacity == 0, sizes * k, steps // capacity * capacity)).sum(), k * capacity))
    many, weight = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * sizes)])
    e = np.arange(1, capacity // 2 + 1)
    big = many[-1] - many[capacity - e + 1]
    middle = weight[capacity - e + 1] - weight[e]
    return max(best, int((big + -(-middle // capacity)).max()))


PACKED = "pid long, length long, part long, sequence long, place long, n_bins long, bound long, volume long"


def _certified(frame: pd.DataFrame, part: int, capacity: int) -> pd.DataFrame:
    lengths = frame["length"].to_numpy()
    return frame.assign(part=part, n_bins=frame["sequence"].nunique(), bound=lower_bound(lengths, capacity),
                        volume=-(-int(lengths.sum()) // capacity))[[x.split()[0] for x in PACKED.split(", ")]]


def _pack(capacity: int):
    def run(key, frame):
        frame = frame.sort_values("pid")
        bins, offsets = best_fit(frame["length"].to_numpy(), capacity)
        return _certified(frame.assign(sequence=(int(key[0]) << 24) + bins, place=offsets), int(key[0]), capacity)
    return run


def _exchange(capacity: int):
    """The documents of some partitions packed anew, all of them or those of bins
    that are not full, whichever gives fewer bins; the old packing stays if neither does."""
    def run(key, frame):
        frame = frame.sort_values("pid").reset_index(drop=True)
        loose = (frame.groupby("sequence")["length"].transform("sum") < capacity).to_numpy()
        best, old = None, frame["sequence"].nunique()
        for pool in (loose, np.ones(len(frame), bool)):
            bins, offsets = best_fit(frame.loc[pool, "length"].to_numpy(), capacity)
            n = old - frame.loc[pool, "sequence"].nunique() + int(bins.max(initial=-1)) + 1
            if n < (best[0] if best else old):
                best = n, pool, bins, offsets
        if best:
            _, pool, bins, offsets = best
            frame.loc[pool, "sequence"] = (int(key[0]) << 24) + bins
            frame.loc[pool, "place"] = offsets
        return _certified(frame, int(key[0]), capacity)
    return run


def _groups(parts: DataFrame, n: int, turn: int) -> DataFrame:
    """(part, deal): partitions dealt to groups of ``EXCHANGE``, other ones in each
    round: by row number in the order of a hash, within slots of about ``SLOT``."""
    slots = -(-n // SLOT)
    order = F.xxhash64("part", F.lit(turn))
    slotted = parts.select("part", F.pmod(F.xxhash64("part", F.lit(turn), F.lit("slot")), F.lit(slots)).alias("slot"), order.alias("order"))
    number = F.row_number().over(Window.partitionBy("slot").orderBy("order", "part")) - 1
    return slotted.select("part", (F.col("slot") + F.lit(slots) * F.floor(number / EXCHANGE)).cast("long").alias("deal"))


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """(sequences, lower bound) of packed pieces with their length and sequence_id."""
    count = np.zeros(capacity + 1, np.int64)
    for r in packed.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most ``capacity`` rows
        count[r["length"]] = r["n"]
    return packed.select("sequence_id").distinct().count(), bound_of_counts(count, capacity)


def pack(table: DataFrame, capacity: int = CAPACITY, size: int = PIECES) -> DataFrame:
    """(pid, sequence, place) of each (pid, length) row: bins of at most ``capacity``.

    The bound of the whole table, from its count of each length, ends the rounds
    once it is reached. A partition has a gap if its bins exceed its own bound or
    the volume of its pieces."""
    spark = table.sparkSession
    count = np.zeros(capacity + 1, np.int64)
    for r in table.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most ``capacity`` rows
        count[r["length"]] = r["n"]
    parts, bound = max(1, -(-int(count.sum()) // size)), bound_of_counts(count, capacity)
    dealt = table.select("pid", "length", F.pmod(F.xxhash64("pid"), F.lit(parts)).alias("deal"))
    paths = [staged_path(dealt.groupBy("deal").applyInPandas(_pack(capacity), PACKED))]
    gap = (F.col("n") > F.col("b")) | (F.col("n") > F.col("v"))
    turn, before = 1, None
    while ROUNDS is None or turn <= ROUNDS:
        now = spark.read.schema(PACKED).parquet(*paths)
        ends = now.groupBy("part").agg(F.max("n_bins").alias("n"), F.max("bound").alias("b"), F.max("volume").alias("v"))
        bins, gaps = ends.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(gap.cast("long")), F.lit(0))).first()
        if bins <= bound or gaps < 2 or before is not None and bins >= before:
            break
        members = _groups(ends.where(gap).select("part"), gaps, turn)
        shift = 2 * parts * turn  # a partition's number is used once
        met = now.join(members, "part").withColumn("deal", F.col("deal") + shift).groupBy("deal").applyInPandas(_exchange(capacity), PACKED)
        after = [staged_path(now.join(members, "part", "left_anti")), staged_path(met)]
        for path in paths:
            unstage(spark, path)
        paths, before, turn = after, bins, turn + 1
    return spark.read.schema(PACKED).parquet(*paths).select("pid", "sequence", "place")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    numbered = stage(pieces(docs, tokenizer, end_id, capacity).withColumn("pid", F.monotonically_increasing_id()))
    packed = pack(numbered.select("pid", "length"), capacity)
    return numbered.join(packed, "pid").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.col("sequence").alias("sequence_id"), F.col("place").alias("offset"))
