"""Counting, pivots, totals, shares and orderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_facts(df: DataFrame, unit: str, label: str) -> DataFrame:
    """F8: drop rows with a NULL or empty unit or label."""
    u, lab = F.col(unit), F.col(label)
    return df.where(u.isNotNull() & (u.cast("string") != "") & lab.isNotNull() & (lab != ""))


def type_counts(df: DataFrame, unit: str, label: str, out: str = "n") -> DataFrame:
    """A1: count per (unit, label); partial aggregation before the shuffle."""
    return valid_facts(df, unit, label).groupBy(unit, label).agg(F.count(F.lit(1)).alias(out))


def count_matrix(df: DataFrame, unit: str, label: str, values: list[str],
                 total: str | None = "total") -> DataFrame:
    """A2 + A3 + R3: counts pivoted on an explicit value list, 0 where a unit
    has no row of a value, plus the row total over all labels, in one
    aggregation (no extra distinct job, no join)."""
    facts = valid_facts(df, unit, label)
    aggs = [F.count_if(F.col(label) == F.lit(v)).alias(v) for v in values]
    if total:
        aggs.append(F.count(F.lit(1)).alias(total))
    return facts.groupBy(unit).agg(*aggs)


def pivot_wide(long: DataFrame, keys: list[str], name: str, value: str, values: list[str],
               fill=0) -> DataFrame:
    """R2: long -> wide on an explicit value list. Absent cells are filled; a
    cell that is there with a NULL value stays NULL."""
    here = [F.col(name) == F.lit(v) for v in values]
    cells = [F.first(F.when(c, F.col(value)), ignorenulls=True) for c in here]
    if fill is not None:
        cells = [F.when(F.count_if(c) == 0, F.lit(fill)).otherwise(x) for c, x in zip(here, cells)]
    return long.groupBy(*keys).agg(*[x.alias(v) for x, v in zip(cells, values)])


def unpivot_long(wide: DataFrame, ids: list[str], cols: list[str], name: str, value: str) -> DataFrame:
    """Wide -> long."""
    return wide.unpivot(ids, cols, name, value)


def column_summary(matrix: DataFrame, cols: list[str], label_col: str, mean_digits: int = 2) -> DataFrame:
    """A4 + U2 + T18: totals row and means row (half-even rounding) from ONE
    global aggregation (partial in every task), turned into two rows. The
    summary rows are a separate frame with a ``row_kind`` column and are
    never mixed into the matrix, so no later step has to drop them (F11)."""
    aggs = []
    for i, c in enumerate(cols):
        aggs.append(F.sum(F.col(f"`{c}`")).cast("double").alias(f"_s{i}"))
        aggs.append(F.bround(F.avg(F.col(f"`{c}`")), mean_digits).alias(f"_m{i}"))
    one = matrix.agg(*aggs)
    rows = F.array(
        F.struct(F.lit("Total").alias(label_col), *[F.col(f"_s{i}").alias(c) for i, c in enumerate(cols)]),
        F.struct(F.lit("Mean").alias(label_col), *[F.col(f"_m{i}").alias(c) for i, c in enumerate(cols)]))
    return one.select(F.inline(rows))


def shares(counts: DataFrame, unit: str, n: str = "n", out: str = "share") -> DataFrame:
    """Share of each count within its unit. Each unit has at most one row
    per label after ``type_counts``, so the window partitions are small."""
    return counts.withColumn(out, F.try_divide(F.col(n).cast("double"),
                                               F.sum(n).over(Window.partitionBy(unit))))


def level_position(col, values: list[str]) -> Column:
    """O2: 1-based position of a value in a custom level list, NULL when the
    value is not in the list (so ``asc_nulls_last`` puts unknown levels last)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.array_position(F.array(*[F.lit(v) for v in values]), c), F.lit(0))


def mean_and_strict_total(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column, the mean ignoring NULLs and the total only when no
    value is NULL. Returns (attribute, mean, total, n, n_missing)."""
    items = []
    for c in cols:
        x = F.col(f"`{c}`").cast("double")
        items.append(F.struct(
            F.lit(c).alias("attribute"),
            F.avg(x).alias("mean"),
            F.when(F.count(x) == F.count(F.lit(1)), F.sum(x)).alias("total"),
            F.count(x).alias("n"),
            (F.count(F.lit(1)) - F.count(x)).alias("n_missing")))
    return df.agg(F.array(*items).alias("_a")).select(F.inline("_a"))
