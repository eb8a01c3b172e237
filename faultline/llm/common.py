"""Helpers that several training-data operators share: staged tables in the
shared folder, and Arrow batches seen as numpy byte, word and gram arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.session import checkpoint_dir

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of text that a Python task looks at together; a longer text is taken alone.
BLOCK_BYTES = 1 << 20


# ------------------------------------------------------------ staged tables

#: Spark's setting to remove an execution's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame) -> DataFrame:
    """Write a table that later steps reread to the folder named by
    ``spark.checkpoint.dir`` and continue from the written copy: lineage is cut
    on storage that outlives an executor."""
    return df.sparkSession.read.schema(df.schema).parquet(staged_path(df))


def staged_path(df: DataFrame) -> str:
    """The shuffle files behind the written table go at once: nothing reads them
    again, and else they stay until the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return path


def unstage(spark: SparkSession, path: str) -> None:
    """Delete a staged table that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def text_id(text: Column) -> Column:
    """128 bits that stand for a text; equal texts share every decision that
    depends on the text alone, so copies are looked at once."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


LAST = (1 << 63) - 1


def key_order(key: str) -> Column:
    """The order of a row's key as a long, a null after all others. Keys that are
    no numbers are ordered by hash."""
    name = F.col(f"`{key}`")
    hashed = F.when(name.isNotNull(), F.shiftrightunsigned(F.xxhash64(name), 1))
    return F.coalesce(name.try_cast("long"), hashed, F.lit(LAST))


# -------------------------------------------------------- texts in a batch

def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) \
        else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"" if kind == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0]: off[-1]]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have at most ``most`` bytes together (one row at least)."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASES = (np.uint64(0x5851F42D4C957F2D), np.uint64(0x2545F4914F6CDD1D))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (shift, multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        base = _BASES[which]
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        up, down = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= 4 * BLOCK_BYTES:
            _POWERS[which] = have
    return have


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of data[starts:ends], from prefix sums of a polynomial."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1, which)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MUL)


def word_spans(offsets: np.ndarray, data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of some texts, and the number of the first
    word of each text. is_word: a table of 256 flags."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = is_word[data]
    begins, ends = inside.copy(), np.zeros(len(data) + 1, bool)
    begins[1:] &= ~inside[:-1]
    ends[1:] = inside[:-1] & ~inside[1:]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    begins[cut] = inside[cut]
    ends[cut] |= inside[cut - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends), np.searchsorted(starts, offsets)


NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: Bytes with A-Z in lower case, and the bytes of words of letters, digits and all that is not ASCII.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = True
ALNUM[128:] = True


def gram_hashes(items: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hashes of each k consecutive items (those at the end run into what follows: mask them)."""
    n = len(items) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base, out = _BASES[1 - which], np.zeros(n, np.uint64)
    for j in range(k):
        out = out * base + items[j: j + n]
    return mixed(out)


def window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """For each w consecutive values the smallest one's place (the last one of ties)."""
    n = len(values) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if w == 1:
        return np.arange(n)
    best, at = values.copy(), np.arange(len(values))
    step = 1
    while step < w:
        move = min(step, w - step)
        m = len(best) - move
        other, right = best[move:], at[move:]
        take = other <= best[:m]
        best, at = np.where(take, other, best[:m]), np.where(take, right, at[:m])
        step += move
    return at[:n]
