"""Word sequences that also start in an earlier text, found level by level.

The first level looks at short grams: of each window of ``window`` words only
the gram with the least hash is looked up (equal windows have equal least
grams). Windows whose gram occurs in several texts form the next level. From
there on windows repeated at one length alone are extended to twice that length:
a longer window is a candidate where both its halves are repeated. Levels go on
until no candidate survives. The level of ``window`` words says which words go;
the higher ones measure how long the repeats are.

Each level is one exchange of hashes (see ``exchange``): a window of a third of
all texts is one request a task. Wholly equal texts are looked at once; of
their rows all but the one with the smallest key repeat it.

Windows are told apart by 64 bits of hash. Defined results: a null text has no
words; a text of fewer than ``window`` words keeps all. A null key counts as
larger than any other and is never earlier than another null. Keys that are no
numbers are ordered by hash. Rows with equal key and text are one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import (NOT_SPACE, blocks, gram_hashes, key_order, mixed, span_hashes, stage, staged_path, text_bytes, text_id, unstage,
                                  window_minima, word_spans)
from faultline.llm.exchange import ANSWER, shared_items, starts_of

WINDOW, GRAM = 13, 6


def _grams(offsets, data, window: int, gram: int):
    """Word hashes, first word of each text, gram hashes, and for each text with
    enough words (its number, the places of least grams of its windows)."""
    starts, ends, first = word_spans(offsets, data, NOT_SPACE)
    words = span_hashes(data, starts, ends)
    grams = gram_hashes(words, gram)
    least = window_minima(grams, window - gram + 1)
    rows = [(d, least[first[d]: first[d + 1] - window + 1]) for d in np.flatnonzero(np.diff(first) >= window).tolist()]
    return words, first, grams, rows


def _key_rows(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(text_bytes(column)[1].tobytes(), np.uint8).reshape(-1, width)


def _gram_items(window: int, gram: int):
    def run(batch: pa.RecordBatch):
        offsets, data = text_bytes(batch.column("text"))
        keys = _key_rows(batch.column("short"), 8)
        for a, b in blocks(offsets):
            _, _, grams, rows = _grams(offsets[a: b + 1] - offsets[a], data[offsets[a]: offsets[b]], window, gram)
            if rows:
                found = [(d, at[starts_of(at)]) for d, at in rows]
                text = np.concatenate([np.full(len(at), d) for d, at in found])
                h = grams[np.concatenate([at for _, at in found])]
                yield keys[a:b], h, text, np.zeros(len(h), np.uint32)
    return run


def _window_items(window: int, gram: int):
    """Windows whose least gram is shared."""
    def run(batch: pa.RecordBatch):
        offsets, data = text_bytes(batch.column("text"))
        keys, answers = _key_rows(batch.column("text_key"), 24), batch.column("answers")
        for a, b in blocks(offsets):
            words, first, grams, rows = _grams(offsets[a: b + 1] - offsets[a], data[offsets[a]: offsets[b]], window, gram)
            long = gram_hashes(words, window)
            text, place = [], []
            for d, at in rows:
                wanted = np.concatenate([np.frombuffer(x["hashes"], np.uint64) for x in answers[a + d].as_py()])
                own = np.flatnonzero(np.isin(grams[at], wanted))
                text.append(np.full(len(own), d))
                place.append(own)
            if text:
                text, place = np.concatenate(text), np.concatenate(place)
                yield keys[a:b], long[first[text] + place], text, place
    return run


def unpacked(answers: list[dict], name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x[name], kind) for x in answers])


def _twice_as_long(length: int):
    """Windows of twice the length whose halves are both repeated."""
    def run(batch: pa.RecordBatch):
        keys = _key_rows(batch.column("text_key"), 24)
        for i, answers in enumerate(batch.column("answers")):
            answers = answers.as_py()
            h, p = unpacked(answers, "hashes", np.uint64), unpacked(answers, "places", np.uint32).astype(np.int64)
            order = np.argsort(p)
            h, p = h[order], p[order]
            at = np.minimum(np.searchsorted(p, p + length), len(p) - 1)
            both = np.flatnonzero(p[at] == p + length)
            if len(both):
                yield keys[i: i + 1], mixed(h[both] * np.uint64(0x9E3779B97F4A7C15) + h[at[both]]), np.zeros(len(both), np.int64), p[both]
    return run


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = text_bytes(batch.column("text"))
        body, number, digest = data.tobytes(), [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            words = body[a:b].split()
            number.append(len(words))
            digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("place"), pa.array(number, pa.int64()), pa.array(digest)],
                                         names=["row", "id", "place", "n_words", "sha256"])


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digest = [], []
            for text, answers in zip(batch.column("text"), batch.column("answers")):
                words = text.as_py().split()
                answers = answers.as_py()
                at = unpacked(answers, "places", np.uint32)[unpacked(answers, "later", np.uint8) > 0].astype(np.int64)
                delta = np.zeros(len(words) + 1, np.int64)
                np.add.at(delta, at, 1)
                np.add.at(delta, at + window, -1)
                gone = np.cumsum(delta[:-1]) > 0
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                removed.append(int(gone.sum()))
                digest.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(removed, pa.int64()), pa.array(digest)],
                                             names=["id", "n_removed", "cut_sha256"])
    return run


def repeated_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_removed, kept_sha256, longest_level) of each
    row. ``longest_level`` is the length of the highest level at which the text
    has a repeated window (0: none)."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    texts = docs.select(F.col(f"`{key}`").alias("row"), text_id(F.col("text")).alias("id"), key_order(key).alias("place"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    whole = stage(texts.mapInArrow(_whole, f"row {kind}, id binary, place long, n_words long, sha256 string"))
    copies = whole.groupBy("id").agg(F.min("place").alias("least"))
    short = F.substring("id", 1, 8)
    answers = shared_items(texts.select(short.alias("short"), "text"), _gram_items(window, gram), 8)
    standing = copies.select(short.alias("text_key"), "id", "least").join(answers, "text_key")
    key24 = F.concat("t.id", F.unhex(F.lpad(F.hex("least"), 16, "0")))
    asked = stage(texts.alias("t").join(standing.alias("s"), (F.col("t.id") == F.col("s.id")) & (F.col("t.place") == F.col("s.least")))
                  .select("t.id", key24.alias("text_key"), "t.text", F.transform("s.answers", lambda x: F.struct(x["hashes"].alias("hashes"))).alias("answers")))
    listed = f"text_key binary, answers array<struct<{', '.join(x.replace(' ', ':') for x in ANSWER.split(', ')[1:])}>>"
    now = staged_path(shared_items(asked, _window_items(window, gram), 24, places=True))
    level = spark.read.schema(listed).parquet(now)
    one_text = asked.select("id", "text").join(level.select(F.substring("text_key", 1, 16).alias("id"), "answers"), "id")
    cut = stage(one_text.mapInArrow(_cut(window), "id binary, n_removed long, cut_sha256 string")
                .select("id", "n_removed", "cut_sha256").dropDuplicates(["id"]))
    lengths, length = [], window
    while not level.isEmpty():
        lengths.append(stage(level.select(F.substring("text_key", 1, 16).alias("id"), F.lit(length).cast("long").alias("length"))))
        after = staged_path(shared_items(level, _twice_as_long(length), 24, places=True))
        unstage(spark, now)
        now, length = after, 2 * length
        level = spark.read.schema(listed).parquet(now)
    unstage(spark, now)
    out = whole.join(copies, "id").join(cut, "id", "left")
    if lengths:
        longest = lengths[0]
        for more in lengths[1:]:
            longest = longest.union(more)
        out = out.join(longest.groupBy("id").agg(F.max("length").alias("length")), "id", "left")
    else:
        out = out.withColumn("length", F.lit(None).cast("long"))
    gone, zero = (F.col("place") > F.col("least")) & (F.col("n_words") >= window), F.lit(0).cast("long")
    columns = [F.col("row").alias(key), "n_words", F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
               F.when(gone, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("cut_sha256", "sha256")).alias("kept_sha256"),
               F.coalesce("length", zero).alias("longest_level")]
    return out.select(*columns)
