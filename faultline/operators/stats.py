"""Rank statistics on the long form (W2, A5, ST1-ST7).

Design for tall inputs (one row per project, many projects):

* Ranks come from value histograms (``ranks.rank_histogram``); a hot value
  is one histogram row.
* Listwise Spearman (ST1): the rank vectors are pivoted back to one row per
  unit and every pair's covariance is computed in ONE global aggregation
  (partial aggregation in every task, a single tiny merge). No self-join.
* Pairwise Spearman (ST3): each unit row is expanded into one row per column
  pair where both values are present (a generator, no join), ranks are taken
  per pair, and the pair aggregates are grouped sums.
* Kruskal-Wallis (ST4): rank sums per group come from the histogram joined
  to its ranks; units are never joined back.

Pearson of ranks is covariance over the product of standard deviations with
``try_divide``: a constant column gives NULL instead of an ANSI error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.stats import chi2_upper_jvm, corr_p_value_col
from faultline.session import materialize
from faultline.operators.ranks import (DEFAULT_RANGE_BUCKETS, histogram, median_from_histogram,
                                      midranks, rank_histogram)


def to_long(wide: DataFrame, unit, names: list[str], name_col: str = "name",
            value_col: str = "value") -> DataFrame:
    """Wide numeric columns -> (unit..., name, value) as double.
    ``unit`` is one id column or a list of them."""
    ids = [unit] if isinstance(unit, str) else list(unit)
    return wide.select(*ids, *[F.col(f"`{c}`").cast("double").alias(c) for c in names]) \
               .unpivot(ids, names, name_col, value_col)


def _rank_cols(names: list[str]) -> dict[str, str]:
    return {n: f"_r{i}" for i, n in enumerate(names)}


def spearman_listwise(wide: DataFrame, unit: str, rows: list[str], cols: list[str] | None = None,
                      buckets: int = DEFAULT_RANGE_BUCKETS, reuse: bool = True) -> DataFrame:
    """ST1 (+F9): Spearman over rows complete in every used column.

    ``cols`` None -> all unordered pairs of ``rows`` (lower triangle, row
    after column in list order). Returns (row_name, col_name, rho, n).
    The complete rows feed the histogram and the join back, so with
    ``reuse`` they are written once to the checkpoint folder.
    """
    names = list(dict.fromkeys(rows + (cols or [])))
    complete = wide.select(unit, *[F.col(f"`{c}`") for c in names]).dropna(how="any", subset=names)
    if reuse:
        complete = materialize(complete)
    long = to_long(complete, unit, names)
    ranked = midranks(long, ["name"], "value", out="rank", buckets=buckets)
    rc = _rank_cols(names)
    per_unit = ranked.groupBy(unit).pivot("name", names).agg(F.first("rank"))
    per_unit = per_unit.select(unit, *[F.col(f"`{n}`").alias(rc[n]) for n in names])
    if cols is None:
        pairs = [(rows[i], rows[j]) for i in range(len(rows)) for j in range(i)]
    else:
        pairs = [(r, c) for r in rows for c in cols]
    aggs = [F.count(F.lit(1)).alias("_n")]
    for n in names:
        aggs.append(F.stddev_samp(rc[n]).alias(f"sd{rc[n]}"))
    for k, (a, b) in enumerate(pairs):
        aggs.append(F.covar_samp(rc[a], rc[b]).alias(f"_c{k}"))
    one = per_unit.agg(*aggs)
    structs = [
        F.struct(F.lit(a).alias("row_name"), F.lit(b).alias("col_name"),
                 F.try_divide(F.col(f"_c{k}"), F.col(f"sd{rc[a]}") * F.col(f"sd{rc[b]}")).alias("rho"))
        for k, (a, b) in enumerate(pairs)
    ]
    return one.select(F.col("_n").alias("n"), F.inline(F.array(*structs))) \
              .select("row_name", "col_name", "rho", "n")


def pair_rows(wide: DataFrame, unit: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """J9 (all pairs of columns): one row per (unit, pair) where both values
    are present, made by a generator over the row (no self-join)."""
    items = [
        F.struct(F.lit(a).alias("row_name"), F.lit(b).alias("col_name"),
                 F.col(f"`{a}`").cast("double").alias("x"), F.col(f"`{b}`").cast("double").alias("y"))
        for a, b in pairs
    ]
    return (wide.select(unit, F.inline(F.array(*items)))
                .where(F.col("x").isNotNull() & F.col("y").isNotNull()))


def spearman_pairwise(wide: DataFrame, unit: str, rows: list[str], cols: list[str] | None = None,
                      buckets: int = DEFAULT_RANGE_BUCKETS, reuse: bool = True) -> DataFrame:
    """ST3: Spearman with NULLs dropped per pair. Returns
    (row_name, col_name, rho, n); ``cols`` None -> lower triangle of rows.
    The pair rows feed two histograms and the join, so with ``reuse`` they
    are written once to the checkpoint folder."""
    if cols is None:
        pairs = [(rows[i], rows[j]) for i in range(len(rows)) for j in range(i)]
    else:
        pairs = [(r, c) for r in rows for c in cols]
    pr = pair_rows(wide, unit, pairs)
    if reuse:
        pr = materialize(pr)
    keys = ["row_name", "col_name"]
    rx = rank_histogram(histogram(pr, keys, "x"), keys, "x", "rx", buckets).drop("_cnt")
    ry = rank_histogram(histogram(pr, keys, "y"), keys, "y", "ry", buckets).drop("_cnt")
    ranked = pr.join(rx, keys + ["x"], "inner").join(ry, keys + ["y"], "inner")
    return ranked.groupBy(*keys).agg(
        F.try_divide(F.covar_samp("rx", "ry"),
                     F.stddev_samp("rx") * F.stddev_samp("ry")).alias("rho"),
        F.count(F.lit(1)).alias("n"))


def with_p_values(corr: DataFrame) -> DataFrame:
    """ST2: two-sided p for each (rho, n) row (JVM expression on aggregated rows)."""
    return corr.withColumn("p_value", corr_p_value_col("rho", "n"))


def kruskal_wallis(long: DataFrame, name: str, group: str, value: str,
                   buckets: int = DEFAULT_RANGE_BUCKETS, reuse: bool = True) -> DataFrame:
    """ST4: Kruskal-Wallis H per ``name`` across ``group``, tie corrected,
    NULL values dropped; df = groups - 1; p from the chi-square tail.
    The (name, group, value) histogram is the only input of the rest (and is
    written once with ``reuse``); rows are never joined back.

    Returns (name, h, df, p_value, n)."""
    hist = histogram(long, [name, group], value)                       # (name, group, value, _cnt)
    if reuse:
        hist = materialize(hist)
    per_value = hist.groupBy(name, value).agg(F.sum("_cnt").alias("_cnt"))
    ranks = rank_histogram(per_value, [name], value, "rank", buckets)  # (name, value, _cnt, rank)
    ties = ranks.groupBy(name).agg(
        F.sum(F.pow(F.col("_cnt").cast("double"), 3) - F.col("_cnt")).alias("_ties"))
    sums = (hist.join(ranks.drop("_cnt"), [name, value], "inner")
                .groupBy(name, group)
                .agg(F.sum(F.col("_cnt") * F.col("rank")).alias("_r"),
                     F.sum("_cnt").alias("_ni")))
    stats = sums.groupBy(name).agg(
        F.sum(F.col("_r") * F.col("_r") / F.col("_ni")).alias("_q"),
        F.sum("_ni").alias("n"),
        F.count(F.lit(1)).alias("_k"))
    big_n = F.col("n").cast("double")
    h_raw = F.lit(12.0) / (big_n * (big_n + 1)) * F.col("_q") - F.lit(3.0) * (big_n + 1)
    denom = F.lit(1.0) - F.try_divide(F.col("_ties"), F.pow(big_n, 3) - big_n)
    out = (stats.join(ties, name, "inner")
                .withColumn("h", F.try_divide(h_raw, F.when(denom != 0, denom)))
                .withColumn("df", (F.col("_k") - 1).cast("int")))
    out = out.withColumn("p_value", F.when(F.col("df") > 0, chi2_upper_jvm("h", "df")))
    return out.select(name, "h", "df", "p_value", "n")


def medians_all_present(df: DataFrame, group: str, cols: list[str],
                        buckets: int = DEFAULT_RANGE_BUCKETS) -> DataFrame:
    """A5: exact median per group and column; any NULL in a group -> NULL.

    Computed on the long form from value histograms (``exact_median``), so a
    group holding a third of all rows is never buffered in one task; the
    NULL rule comes from a per-(group, column) count."""
    long = to_long(df, group, cols, "_name", "_value")
    # One histogram, NULL values included: it feeds both the NULL rule and the
    # ranks, so the input is aggregated once (the exchange is reused).
    hist = long.groupBy(group, "_name", "_value").agg(F.count(F.lit(1)).alias("_cnt"))
    med = median_from_histogram(hist, [group, "_name"], "_value", "_median", buckets)
    complete = hist.groupBy(group, "_name").agg(
        (F.sum(F.when(F.col("_value").isNull(), F.col("_cnt")).otherwise(F.lit(0))) == 0).alias("_complete"))
    cell = complete.join(med, [group, "_name"], "left") \
                   .select(group, "_name", F.when(F.col("_complete"), F.col("_median")).alias("_m"))
    return cell.groupBy(group).pivot("_name", cols).agg(F.first("_m"))


def zscores(long: DataFrame, by: str, value: str, out: str = "z") -> DataFrame:
    """(x - mean) / sample sd within ``by``; sd 0 or undefined -> NULL.
    Meant for aggregated profiles (one row per domain and category)."""
    w = Window.partitionBy(by)
    sd = F.stddev_samp(value).over(w)
    return long.withColumn(out, F.try_divide(F.col(value) - F.avg(value).over(w),
                                             F.when(sd != 0, sd)))


def profile_distance(long: DataFrame, item: str, feature: str, value: str, n_features: int) -> DataFrame:
    """ST5 + J9 (all pairs of rows): Euclidean distance between item profiles
    over shared features.

    Missing coordinates are skipped and the sum is scaled by
    ``n_features / used`` (the rule R's ``dist`` applies to NA). The input is
    an aggregated profile (items x features); the self-join is on the
    feature key with ``a < b``, one row per unordered item pair."""
    a = long.where(F.col(value).isNotNull()).select(
        F.col(item).alias("item_a"), F.col(feature).alias("_f"), F.col(value).alias("_va"))
    b = long.where(F.col(value).isNotNull()).select(
        F.col(item).alias("item_b"), F.col(feature).alias("_f"), F.col(value).alias("_vb"))
    j = a.join(b, "_f").where(F.col("item_a") < F.col("item_b"))
    return j.groupBy("item_a", "item_b").agg(
        F.sqrt(F.sum(F.pow(F.col("_va") - F.col("_vb"), 2)) * F.lit(float(n_features))
               / F.count(F.lit(1))).alias("distance"))
