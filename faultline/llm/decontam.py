"""Benchmark decontamination: an FM-index for each shard of documents.

The benchmark's windows are the stated query set. It is cut into blocks of a
bounded size, whatever its own; each block is looked up in every shard. A shard
is some megabytes of whole documents: its words become numbers of the block's
vocabulary, stretches of words outside the vocabulary (which no window can
cross) become separators, and the rest is indexed. Windows are searched
backwards through wavelet-tree ranks, occurrences are located by sampled suffix
positions, and the spans of all windows are merged for each document.

Defined results: a null or empty text has no words, hits or spans. An item
without words is ignored; one with a null id hits words but is not listed.
Items with one id count once. Repeated rows each get their row. Columns of the
input with the names of result columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import ALNUM, FOLD, blocks, span_hashes, stage, text_bytes, word_spans
from faultline.llm.fmindex import FMIndex

WINDOW = 10
#: Bytes of text of a shard, and of a block of the benchmark (its broadcast bound; an item is not cut).
SHARD_BYTES, BENCHMARK_BYTES = 2 << 20, 8 << 20
#: Blocks that one job looks up before its result is written.
BLOCKS_A_JOB = 4

RESULTS = {"n_words": "long", "n_hit": "long", "items": "array<string>", "span_starts": "array<long>", "span_ends": "array<long>"}


class Phrases:
    """A block of the benchmark: its vocabulary, and its windows by length."""

    def __init__(self, ids: list, texts: list[str], window: int):
        offsets, data = text_bytes(pa.array(texts, pa.large_string()))
        data = FOLD[data]
        starts, ends, first = word_spans(offsets, data, ALNUM)
        self.vocabulary, symbol = np.unique(span_hashes(data, starts, ends), return_inverse=True)
        symbol = symbol.astype(np.int64) + 1
        grams: dict[tuple, set] = {}
        for i, name in enumerate(ids):
            words = symbol[first[i]: first[i + 1]].tolist()
            for k in range(max(1, len(words) - window + 1) if words else 0):
                grams.setdefault(tuple(words[k: k + window]), set()).add(name)
        self.names = sorted({x for x in ids if x is not None})
        number = {x: i for i, x in enumerate(self.names)}
        self.by_length = {}
        for length in sorted({len(g) for g in grams}):
            rows = [g for g in grams if len(g) == length]
            owners = [[number[x] for x in grams[g] if x is not None] for g in rows]
            self.by_length[length] = (np.array(rows, np.int64), np.cumsum([0, *map(len, owners)]),
                                      np.array([x for o in owners for x in o], np.int64))

    def hits(self, offsets: np.ndarray, data: np.ndarray):
        """Of the documents of a shard: word bounds, flags of hit words, and (document, item) pairs."""
        data = FOLD[data]
        starts, ends, first = word_spans(offsets, data, ALNUM)
        hit, none = np.zeros(len(starts), bool), (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if not self.by_length or not len(starts):
            return starts, ends, first, hit, none
        words = span_hashes(data, starts, ends)
        at = np.searchsorted(self.vocabulary, words)
        at[at == len(self.vocabulary)] = 0
        symbol = np.where(self.vocabulary[at] == words, at + 1, 0)
        # Stretches of known words of one document, long enough for a window.
        known = symbol > 0
        begins = known.copy()
        begins[1:] &= ~known[:-1]
        opens = first[:-1][first[:-1] < len(symbol)]
        begins[opens] = known[opens]
        run = np.cumsum(begins) - 1
        size = np.bincount(run[known], minlength=int(run[-1]) + 1)
        known[known] = size[run[known]] >= min(self.by_length)
        place = np.flatnonzero(known)
        if not len(place):
            return starts, ends, first, hit, none
        cut = np.flatnonzero(run[place[1:]] != run[place[:-1]]) + 1
        text = np.append(np.insert(symbol[place], cut, 0), 0)
        place = np.append(np.insert(place, cut, -1), -1)
        index = FMIndex(text, len(self.vocabulary))
        delta = np.zeros(len(starts) + 1, np.int64)
        docs, items = [], []
        for length, (patterns, owner_from, owners) in self.by_length.items():
            low, high = index.search(patterns)
            found = np.flatnonzero(high > low)
            if not len(found):
                continue
            many = high[found] - low[found]
            which = np.repeat(found, many)
            rows = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + low[which]
            word = place[index.locate(rows)]
            np.add.at(delta, word, 1)
            np.add.at(delta, word + length, -1)
            doc = np.searchsorted(first, word, side="right") - 1
            pair = np.unique(doc * len(patterns) + which)
            d, w = pair // len(patterns), pair % len(patterns)
            n = owner_from[w + 1] - owner_from[w]
            docs.append(np.repeat(d, n))
            items.append(owners[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(owner_from[w], n)])
        hit = np.cumsum(delta[:-1]) > 0
        if docs:
            pair = np.unique(np.concatenate(docs) * max(1, len(self.names)) + np.concatenate(items))
            none = pair // max(1, len(self.names)), pair % max(1, len(self.names))
        return starts, ends, first, hit, none


def _rows(ids: list, texts: list[str], window: int, text: str, names: list[str], keep: list[str]):
    """A shard at a time; results of earlier blocks, if any, are in the batch and are merged."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(ids, texts, window)
        for batch in batches:
            offsets, data = text_bytes(batch.column(text))
            old = {n: batch.column(n) for n in RESULTS} if names else None
            n_words, n_hit, items, begin, end = [], [], [], [], []
            for a, b in blocks(offsets, SHARD_BYTES):
                starts, ends, first, hit, (doc, item) = phrases.hits(offsets[a: b + 1] - offsets[a], data[offsets[a]: offsets[b]])
                if old is not None:  # words that an earlier block's spans cover
                    for i in range(a, b):
                        for x, y in zip(old["span_starts"][i].as_py(), old["span_ends"][i].as_py()):
                            s = slice(first[i - a], first[i - a + 1])
                            base = offsets[i] - offsets[a]
                            hit[s] |= (starts[s] >= base + x) & (ends[s] <= base + y)
                n_words += np.diff(first).tolist()
                sums = np.concatenate([[0], np.cumsum(hit)])
                n_hit += (sums[first[1:]] - sums[first[:-1]]).tolist()
                at = np.searchsorted(doc, np.arange(b - a + 1))
                opens, closes = hit.copy(), hit.copy()
                opens[1:] &= ~hit[:-1]
                closes[:-1] &= ~hit[1:]
                for i in range(b - a):
                    named = {phrases.names[x] for x in item[at[i]: at[i + 1]].tolist()}
                    items.append(sorted(named | set(old["items"][a + i].as_py()) if old is not None else named))
                    s, e, base = int(first[i]), int(first[i + 1]), int(offsets[a + i] - offsets[a])
                    if n_hit[a + i] == 0:
                        begin.append([])
                        end.append([])
                        continue
                    o, c = opens[s:e].copy(), closes[s:e].copy()
                    o[0], c[-1] = hit[s], hit[e - 1]
                    begin.append((starts[s:e][o] - base).tolist())
                    end.append((ends[s:e][c] - base).tolist())
            made = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())),
                    pa.array(begin, pa.list_(pa.int64())), pa.array(end, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + made, names=[*keep, *RESULTS])
    return run


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """The columns of ``docs`` with n_words, n_hit, items (ids as sorted strings)
    and the byte spans (start, end) of hit words in the text."""
    keep = [c for c in docs.columns if c.lower() not in RESULTS]
    out = docs.select(*[F.col(f"`{c}`") for c in keep])
    shown = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    schema = shown + ", " + ", ".join(f"{n} {t}" for n, t in RESULTS.items())
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + F.lit(32))).first()[0] or 0
    n = max(1, -(-int(size) // BENCHMARK_BYTES))
    names: list[str] = []
    for block in range(n):
        mine = items if n == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == block)
        rows = mine.distinct().orderBy("id", "text").collect()
        out = out.mapInArrow(_rows([r["id"] for r in rows], [r["text"] for r in rows], window, text, names, keep), schema)
        names = list(RESULTS)
        if block % BLOCKS_A_JOB == BLOCKS_A_JOB - 1 and block + 1 < n:
            out = stage(out)
    return out


def remove_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """``find``'s rows with the spans cut out of the text; the result columns go."""
    spans = F.arrays_zip("span_starts", "span_ends")
    raw = F.col(f"`{text}`").cast("binary")
    piece = lambda a, b: F.substring(raw, a.cast("int") + 1, (b - a).cast("int"))
    gaps = F.transform(spans, lambda s, i: piece(F.coalesce(F.get("span_ends", i - 1), F.lit(0).cast("long")), s["span_starts"]))
    rest = piece(F.element_at("span_ends", -1), F.octet_length(f"`{text}`").cast("long"))
    hexes = F.concat(F.array_join(F.transform(gaps, lambda g: F.hex(g)), ""), F.hex(rest))
    cut = F.when(F.size("span_starts") > 0, F.unhex(hexes).cast("string")).otherwise(F.col(f"`{text}`"))
    return found.withColumn(text, cut).drop(*RESULTS)


