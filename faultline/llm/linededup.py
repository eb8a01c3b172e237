"""Runs of lines that repeat an earlier run, by winnowing over line hashes.

Of each ``run`` consecutive lines the line with the least hash is a fingerprint,
so any two equal runs of that length or more share one (guaranteed). Lines that
are fingerprints in several places are joined with the places where they are;
around each such place the match is extended both ways, over the windows of
``run`` lines that hold it, and a window that occurs earlier (in a document
smaller in order, or further up in the same one) is a later repeat. All lines of
later repeats go; overlapping windows make up runs of any length.

With ``words``, shorter runs count too if they hold at least that many words (one
long line, or two): each such run is an item of its own, so a passage of that many
words in whole lines is found whatever its neighbours are.

Only line hashes travel; the texts are joined once, with the numbers of the
lines that go. Order is by key, a null key last; of two texts with one key neither is earlier.

Defined results: a null or empty text has no lines. Rows with equal key and
text are one document. Blank lines are lines like any other. A document of
fewer than ``run`` lines keeps all but those that ``words`` takes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import NOT_SPACE, blocks, key_order, span_hashes, stage, text_bytes, text_id, window_minima, word_spans
from faultline.llm.exchange import shared_items, starts_of

RUN = 3
#: Words of a passage of fewer lines that the registered query and the pipeline take too.
WORDS = 50


def document_key(key: str):
    """24 bytes that name a row: its text's id and its key; the key's order comes last."""
    return F.concat(text_id(F.col("text")), F.unhex(F.lpad(F.hex(key_order(key)), 16, "0")))


def _lines(weigh: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_bytes(batch.column("text"))
            packed, number, digest, weight = [], [], [], []
            for a, b in blocks(offsets):
                off, raw = offsets[a: b + 1] - offsets[a], data[offsets[a]: offsets[b]]
                body = raw.tobytes()
                breaks = np.flatnonzero(raw == 10)
                for i, j in zip(off[:-1].tolist(), off[1:].tolist()):
                    digest.append(hashlib.sha256(body[i:j]).hexdigest())
                first = np.searchsorted(breaks, off)
                filled = np.flatnonzero(np.diff(off))
                starts = np.sort(np.concatenate([off[:-1][filled], breaks + 1]))
                ends = np.sort(np.concatenate([breaks, off[1:][filled]]))
                hashes = span_hashes(raw, starts, ends)
                heads = word_spans(off, raw, NOT_SPACE)[0] if weigh else ends[:0]
                words = (np.searchsorted(heads, ends) - np.searchsorted(heads, starts)).astype(np.uint32)
                n = np.zeros(b - a, np.int64)
                n[filled] = 1 + np.diff(first)[filled]
                cut = np.concatenate([[0], np.cumsum(n)])
                number += n.tolist()
                packed += [hashes[cut[d]: cut[d + 1]].tobytes() for d in range(b - a)]
                weight += [words[cut[d]: cut[d + 1]].tobytes() if weigh else None for d in range(b - a)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("text_key"), pa.array(number, pa.int64()), pa.array(digest), pa.array(packed, pa.binary()),
                 pa.array(weight, pa.binary())],
                names=["row", "text_key", "n_lines", "sha256", "lines", "words"])
    return run


def _texts(batch: pa.RecordBatch):
    """Line hashes, and the number of each text's first line."""
    offsets, data = text_bytes(batch.column("lines"))
    return np.frombuffer(data.tobytes(), np.uint64), offsets // 8, np.frombuffer(text_bytes(batch.column("text_key"))[1].tobytes(), np.uint8).reshape(-1, 24)


def _fingerprint_items(run: int):
    def items(batch: pa.RecordBatch):
        lines, first, keys = _texts(batch)
        least = window_minima(lines, run)
        rows = [least[first[d]: first[d + 1] - run + 1] for d in range(len(keys)) if first[d + 1] - first[d] >= run]
        if rows:
            at = np.unique(np.concatenate(rows))
            text = np.searchsorted(first, at, side="right") - 1
            yield keys, lines[at], text, at - first[text]
    return items


def window_hashes(lines: np.ndarray, run: int) -> np.ndarray:
    n, out = len(lines) - run + 1, None
    for j in range(run):
        part = lines[j: j + n]
        out = part.copy() if out is None else (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + part
    return out


def _near(lines: np.ndarray, wanted: np.ndarray, run: int) -> np.ndarray:
    """Starts of the windows of a text whose fingerprint is shared."""
    least = window_minima(lines, run)
    return np.flatnonzero(np.isin(lines[least], wanted))


def _wanted(answers) -> np.ndarray:
    return np.concatenate([np.frombuffer(x["hashes"], np.uint64) for x in answers.as_py()])


def _window_items(run: int):
    def items(batch: pa.RecordBatch):
        lines, first, keys = _texts(batch)
        for d, answers in enumerate(batch.column("answers")):
            mine = lines[first[d]: first[d + 1]]
            at = _near(mine, _wanted(answers), run)
            if len(at):
                yield keys[d: d + 1], window_hashes(mine, run)[at], np.zeros(len(at), np.int64), at
    return items


def _gone(run: int):
    """The numbers of the lines that go."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, first, keys = _texts(batch)
            out = []
            for d, (answers, later) in enumerate(zip(batch.column("answers"), batch.column("found"))):
                mine = lines[first[d]: first[d + 1]]
                at = _near(mine, _wanted(answers), run)
                h = window_hashes(mine, run)[at]
                # Further up in the same document: the same hash at an earlier window.
                order = np.lexsort((at, h))
                again = order[~np.isin(np.arange(len(h)), starts_of(h[order]))]
                starts = [at[again]]
                for x in later.as_py() or []:
                    starts.append(np.frombuffer(x["places"], np.uint32)[np.frombuffer(x["later"], np.uint8) > 0].astype(np.int64))
                s = np.concatenate(starts)
                delta = np.zeros(len(mine) + 1, np.int64)
                np.add.at(delta, s, 1)
                np.add.at(delta, s + run, -1)
                out.append(np.flatnonzero(np.cumsum(delta[:-1]) > 0).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), pa.array(out, pa.list_(pa.int64()))], names=["text_key", "gone"])
    return make


def _passages(lines: np.ndarray, weight: np.ndarray, run: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places (first line * run + number of lines) of a text's runs of
    fewer than ``run`` lines that hold at least ``words`` words."""
    total, hashes, places = np.concatenate([[0], np.cumsum(weight, dtype=np.int64)]), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for k in range(1, min(run, len(lines) + 1)):
        at = np.flatnonzero(total[k:] - total[:-k] >= words)
        hashes.append(window_hashes(lines, k)[at] ^ (np.uint64(k) << np.uint64(56)))
        places.append(at * run + k)
    return np.concatenate(hashes), np.concatenate(places)


def _weighed(batch: pa.RecordBatch):
    lines, first, keys = _texts(batch)
    weight = np.frombuffer(text_bytes(batch.column("words"))[1].tobytes(), np.uint32)
    return [(keys[d: d + 1], lines[a:b], weight[a:b]) for d, (a, b) in enumerate(zip(first[:-1], first[1:]))]


def _passage_items(run: int, words: int):
    def items(batch: pa.RecordBatch):
        for key, lines, weight in _weighed(batch):
            hashes, places = _passages(lines, weight, run, words)
            if len(hashes):
                yield key, hashes, np.zeros(len(hashes), np.int64), places
    return items


def _passages_gone(run: int, words: int):
    """The numbers of the lines of passages that are later repeats."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for (_, lines, weight), later in zip(_weighed(batch), batch.column("found")):
                h, places = _passages(lines, weight, run, words)
                # Further up in the same document: the same hash at an earlier place.
                order = np.lexsort((places, h))
                took = [places[order[~np.isin(np.arange(len(h)), starts_of(h[order]))]]]
                for x in later.as_py() or []:
                    took.append(np.frombuffer(x["places"], np.uint32)[np.frombuffer(x["later"], np.uint8) > 0].astype(np.int64))
                s = np.concatenate(took)
                delta = np.zeros(len(lines) + 1, np.int64)
                np.add.at(delta, s // run, 1)
                np.add.at(delta, s // run + s % run, -1)
                out.append(np.flatnonzero(np.cumsum(delta[:-1]) > 0).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), pa.array(out, pa.list_(pa.int64()))], names=["text_key", "gone"])
    return make


def later_lines(docs: DataFrame, run: int = RUN, key: str = "doc_id", words: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows (row, text_key, n_lines, sha256) and, for documents that lose
    lines, (text_key, gone): the line numbers from 0."""
    kind = docs.schema[key].dataType.simpleString()
    texts = docs.select(F.col(f"`{key}`").alias("row"), document_key(key).alias("text_key"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    rows = stage(texts.mapInArrow(_lines(words is not None), f"row {kind}, text_key binary, n_lines long, sha256 string, lines binary, words binary"))
    lined = rows.where(F.col("n_lines") >= run).select("text_key", "lines").dropDuplicates(["text_key"])
    answers = shared_items(lined, _fingerprint_items(run), 24, twice=True)
    asked = stage(lined.join(answers.select("text_key", F.transform("answers", lambda x: F.struct(x["hashes"].alias("hashes"))).alias("answers")), "text_key"))
    found = shared_items(asked, _window_items(run), 24, places=True).withColumnRenamed("answers", "found")
    gone = asked.join(found, "text_key", "left").mapInArrow(_gone(run), "text_key binary, gone array<long>")
    if words is not None:
        weighed = rows.where(F.col("n_lines") > 0).select("text_key", "lines", "words").dropDuplicates(["text_key"])
        found = shared_items(weighed, _passage_items(run, words), 24, places=True).withColumnRenamed("answers", "found")
        more = weighed.join(found, "text_key", "left").mapInArrow(_passages_gone(run, words), "text_key binary, gone array<long>")
        both = gone.union(more).where(F.size("gone") > 0).groupBy("text_key").agg(F.flatten(F.collect_list("gone")).alias("gone"))
        gone = both.select("text_key", F.sort_array(F.array_distinct("gone")).alias("gone"))
    return rows.select("row", "text_key", "n_lines", "sha256"), stage(gone.where(F.size("gone") > 0))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = []
        for t, gone in zip(batch.column("text"), batch.column("gone")):
            drop = set(gone.as_py())
            text.append("\n".join(x for i, x in enumerate((t.as_py() or "").split("\n")) if i not in drop))
        yield pa.RecordBatch.from_arrays([batch.column("text_key"), pa.array(text, pa.string())], names=["text_key", "kept_text"])


def _cut_texts(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """(text_key, kept_text) of documents that lose lines."""
    texts = docs.select(document_key(key).alias("text_key"), F.col("text").cast("string").alias("text"))
    # Merge join at every size: the line numbers grow with the texts, so they are never broadcast.
    return texts.join(gone.hint("merge"), "text_key").mapInArrow(_kept, "text_key binary, kept_text string").dropDuplicates(["text_key"])


def dedup_report(docs: DataFrame, run: int = RUN, key: str = "doc_id", words: int | None = None) -> DataFrame:
    """(key, n_lines, n_removed, kept_sha256, removed): one row a row of ``docs``."""
    rows, gone = later_lines(docs, run, key, words)
    cut = _cut_texts(docs, gone, key).select("text_key", F.sha2("kept_text", 256).alias("cut")).join(gone, "text_key")
    none = F.array().cast("array<bigint>")
    return rows.join(cut, "text_key", "left").select(
        F.col("row").alias(key), "n_lines", F.coalesce(F.size("gone").cast("long"), F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("cut", "sha256").alias("kept_sha256"), F.coalesce("gone", none).alias("removed"))


def dedup_lines(docs: DataFrame, run: int = RUN, key: str = "doc_id", words: int | None = None) -> DataFrame:
    """``docs`` with later repeats cut from the texts (all columns and rows stay)."""
    _, gone = later_lines(docs, run, key, words)
    gone = gone.select(F.col("text_key").alias("__key"), F.col("gone").alias("__gone"))
    joined = docs.withColumn("__key", document_key(key)).join(gone.hint("merge"), "__key", "left")
    lines = F.split(F.col("text").cast("string"), "\n", -1)
    # Both lists are in order; a line stays if its number is not among those that go.
    keep = F.array_except(F.sequence(F.lit(0).cast("long"), F.size(lines).cast("long") - 1), F.col("__gone"))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(keep, lambda i: F.get(lines, i.cast("int"))), "\n"))
    return joined.withColumn("text", text).select(*[F.col(f"`{c}`") for c in docs.columns])
