"""Ranks and positions that stay distributed (W1, W4, W6, M4 helpers).

A window with only ``orderBy`` (or a ``partitionBy`` on a handful of names)
puts all rows of a key into one task. The helpers here avoid that:

* ``midranks`` ranks the *value histogram* (``groupBy(key, value).count()``,
  partially aggregated before the shuffle, so a hot value collapses to one
  row), range-partitions it on (key, value) with sampled bounds, ranks inside
  each range and adds the row counts of the ranges before it. A value is one
  histogram row, so ties never straddle a range and average ranks are exact.
* ``positions`` numbers rows 0..n-1 per key in a total order, and
  ``global_positions`` all rows: a range repartition (balanced by sampling,
  written once), with offsets from the small (key, range) count table.
* ``first_by`` keeps the first row per key with ``min_by`` (partial
  aggregation, no per-key sort).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Number of range partitions for ranking; None -> spark.sql.shuffle.partitions.
DEFAULT_RANGE_BUCKETS = None
# Most rows of the offsets table that ``global_positions`` broadcasts (about 20 MB).
MAX_BROADCAST_RANGES = 1_000_000


def _fixed_ranges(x: DataFrame) -> DataFrame:
    """The per-range counts and the in-range numbering must see the same
    ranges. Two scans of one range repartition need not: Catalyst prunes their
    columns apart and each samples its own bounds. So the partitioned rows are
    written once to the checkpoint folder and both read that copy."""
    from faultline.session import materialize
    return materialize(x)


def histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, _cnt) for non-NULL values; partial aggregation runs
    before the shuffle, so a hot value costs one row per map task."""
    return (df.where(F.col(value).isNotNull())
              .groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_cnt")))


def rank_histogram(hist: DataFrame, keys: list[str], value: str, out: str = "rank",
                   buckets: int | None = DEFAULT_RANGE_BUCKETS) -> DataFrame:
    """Mid ranks on a histogram (keys, value, _cnt) -> adds ``out``.

    The histogram (one row per distinct value and key) is range-partitioned
    on (keys, value); bounds come from sampling, so partitions are balanced
    whatever the skew of keys. Each partition's row count per key gives the
    offsets; inside a (key, partition) slice a window accumulates counts.
    No sort ever spans more than one range partition. ``buckets`` is the
    number of range partitions (default: ``spark.sql.shuffle.partitions``,
    which is sized to the cluster)."""
    n = buckets or int(hist.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    x = _fixed_ranges(hist.repartitionByRange(n, *[F.col(k) for k in keys], F.col(value))
                                .withColumn("_part", F.spark_partition_id()))
    per_part = x.groupBy(*keys, "_part").agg(F.sum("_cnt").alias("_ptot"))
    w_off = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.withColumn("_off", F.coalesce(F.sum("_ptot").over(w_off), F.lit(0))).drop("_ptot")
    w_in = Window.partitionBy(*keys, "_part").orderBy(value) \
                 .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (x.withColumn("_cum", F.sum("_cnt").over(w_in))
             .join(offsets, keys + ["_part"], "inner")
             .withColumn(out, (F.col("_off") + F.col("_cum") - F.col("_cnt")).cast("double")
                         + (F.col("_cnt") + F.lit(1)).cast("double") / F.lit(2.0))
             .drop("_part", "_cum", "_off"))


def midranks(df: DataFrame, keys: list[str], value: str, out: str = "rank",
             buckets: int = DEFAULT_RANGE_BUCKETS) -> DataFrame:
    """Average (mid) rank of ``value`` within each ``keys`` group.

    Rows with a NULL value keep a NULL rank and do not count. The result has
    the input columns plus ``out``.
    """
    ranked = rank_histogram(histogram(df, keys, value), keys, value, out, buckets).drop("_cnt")
    return df.join(ranked, keys + [value], "left")


def exact_median(df: DataFrame, keys: list[str], value: str, out: str = "median",
                 buckets: int = DEFAULT_RANGE_BUCKETS) -> DataFrame:
    """Exact median per key without buffering a group in one task.
    NULLs are ignored; a key with no value is absent."""
    return median_from_histogram(histogram(df, keys, value), keys, value, out, buckets)


def median_from_histogram(hist: DataFrame, keys: list[str], value: str, out: str = "median",
                          buckets: int = DEFAULT_RANGE_BUCKETS) -> DataFrame:
    """Exact median from a value histogram (keys, value, _cnt), NULL values
    excluded. The histogram is ranked (``rank_histogram``); each distinct
    value covers positions [rank - (c-1)/2, rank + (c-1)/2]; the median is
    the mean of the values at positions floor((n+1)/2) and ceil((n+1)/2)."""
    hist = hist.where(F.col(value).isNotNull())
    ranked = rank_histogram(hist, keys, value, "_rank", buckets)
    sizes = hist.groupBy(*keys).agg(F.sum("_cnt").alias("_n"))
    half = (F.col("_cnt") - 1).cast("double") / 2.0
    lo = F.floor((F.col("_n") + 1) / 2.0)
    hi = F.ceil((F.col("_n") + 1) / 2.0)
    start, end = F.col("_rank") - half, F.col("_rank") + half
    x = ranked.join(sizes, keys, "inner").where(((start <= lo) & (lo <= end)) | ((start <= hi) & (hi <= end)))
    v = F.col(value).cast("double")
    return x.groupBy(*keys).agg(
        ((F.min(F.when((start <= lo) & (lo <= end), v)) + F.min(F.when((start <= hi) & (hi <= end), v)))
         / 2.0).alias(out))


def positions(df: DataFrame, keys: list[str], order: list[str], out: str = "pos", partitions: int | None = None) -> DataFrame:
    """0-based position per ``keys`` in ``order`` (a total order within a key).

    Rows are range-partitioned on (keys, order), so a key of any size is spread
    over as many ranges as it fills."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    x = _fixed_ranges(df.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()))
    counts = x.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    w_off = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w_off), F.lit(0))).drop("_n")
    w = Window.partitionBy(*keys, "_part").orderBy(*order)
    return (x.withColumn("_rn", F.row_number().over(w))
             .join(offsets, keys + ["_part"], "inner")
             .withColumn(out, F.col("_off") + F.col("_rn") - 1)
             .drop("_part", "_rn", "_off"))


def global_positions(df: DataFrame, order: list[Column], out: str = "position",
                     partitions: int | None = None) -> DataFrame:
    """1-based position of each row in a total order (W6 over tall data).

    Rows are range-partitioned on the order (bounds from sampling, so ranges
    are balanced); each range's row count gives its offset; inside a range a
    window numbers the rows. ``order`` must be a total order (end it with a
    unique column)."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    x = _fixed_ranges(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    counts = x.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    w_off = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range partition: the offsets table is bounded by ``n``, which is checked.
    if n > MAX_BROADCAST_RANGES:
        raise ValueError(f"{n} ranges: at most {MAX_BROADCAST_RANGES}")
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w_off), F.lit(0))).drop("_n")
    w = Window.partitionBy("_part").orderBy(*order)
    return (x.withColumn("_rn", F.row_number().over(w))
             .join(F.broadcast(offsets), "_part", "inner")
             .withColumn(out, F.col("_off") + F.col("_rn"))
             .drop("_part", "_rn", "_off"))


def first_by(df: DataFrame, keys: list[str], order: str, cols: list[str]) -> DataFrame:
    """First row per key by ``order`` (ties broken by the full struct)."""
    packed = F.struct(F.col(order).alias("_o"), *[F.col(c) for c in cols])
    picked = df.groupBy(*keys).agg(F.min(packed).alias("_first"))
    return picked.select(*keys, *[F.col("_first")[c].alias(c) for c in cols])
