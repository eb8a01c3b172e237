"""Quality rules as a bitmask ledger (DataFrame functions only).

``evaluate`` looks at every text once and keeps, beside the measurements, one
bit for each rule that the text fails. A policy is a version with a mask of
rules: ``apply_policy`` needs the ledger alone, so another policy costs no pass
over the texts, and ``ablation`` tells by bitwise aggregation what each rule
rejects, alone and together with others.

Defined results: a null or empty text has no words and fails ``few_words``; a
text without words passes rules that are shares of its words or lines. Repeated
rows each get their own row. Columns of the input with the names of ledger
columns are replaced by the ledger's (``ledger`` keeps the key columns only).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import SPACES
from faultline.sources.tables import pinned

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

#: (name, condition under which a text fails), over integer measurements; bit i is rule i.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "2 * n_dup_lines > n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version of the rules that count; ``rules`` are names of RULES."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[x] for x in set(self.rules))


BASE = Policy("base", ("few_words", "repeated_words"))
STRICT = Policy("v1", tuple(BIT))


def _array_measures(words: Column) -> tuple[Column, Column]:
    """Sorted (3-word sequence, place) pairs of a text."""
    n = F.size(words)
    pairs = F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.struct(
        F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)).alias("s"), i.alias("p")))
    return n, F.sort_array(pairs)


def evaluate(df: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``df`` (those named like a ledger column go), the measurements and ``fail_bits``."""
    taken = {x.lower() for x in [*MEASURES, "fail_bits"]}
    out = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken],
                    F.struct(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")).alias("__x"))
    t = F.col("__x.t")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("__y", F.struct(
        F.array_remove(F.split(t, SPACES, -1), "").alias("words"), lines.alias("lines"),
        (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"))).drop("__x")
    words = F.col("__y.words")
    n, pairs = _array_measures(words)
    out = out.withColumn("__z", F.struct(
        n.cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.col("__y.n_symbols").alias("n_symbols"),
        (F.size("__y.lines") - F.size(F.array_distinct("__y.lines"))).cast("long").alias("n_dup_lines"),
        F.size("__y.lines").cast("long").alias("n_lines"))).withColumn("__p", pairs).drop("__y")
    # Neighbours in sorted order with the same sequence are repeats; their places come back in order.
    sorted_pairs = F.col("__p")
    same = lambda x, y: F.coalesce(F.get(sorted_pairs, y)["s"] == x["s"], F.lit(False))
    places = F.sort_array(F.filter(F.transform(sorted_pairs, lambda x, i: F.when(
        same(x, i - 1) | same(x, i + 1), x["p"])), lambda p: p.isNotNull()))
    out = out.withColumn("__q", places).drop("__p")
    covered = F.aggregate(F.transform("__q", lambda p, i: F.least(F.lit(3), F.coalesce(
        F.get(F.col("__q"), i + 1) - p, F.lit(3))).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    out = out.withColumns({m: F.col(f"__z.{m}") for m in MEASURES if m != "n_repeat_words"} | {"n_repeat_words": covered})
    out = out.drop("__z", "__q")
    bits = sum((F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, rule) in enumerate(RULES)),
               F.lit(0)).cast("long")
    # Pinned: a filter on the ledger must not be pushed below it, where it would repeat every measurement.
    return out.withColumn("fail_bits", pinned(bits))


def apply_policy(ledger: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with ``base_failed``, ``kept`` and the policy's version."""
    fails = lambda p: F.col("fail_bits").bitwiseAND(F.lit(p.mask)) != 0
    return ledger.withColumns({"base_failed": fails(BASE), "kept": ~fails(BASE) & ~fails(policy),
                               "policy": F.lit(policy.version)})


def ablation(ledger: DataFrame, policies: list[Policy]) -> DataFrame:
    """For each policy and rule: rows, rows rejected, rows that fail the rule,
    and rows rejected by that rule alone (kept without it). The ledger is first
    counted by its bits, so only distinct bit sets meet. An empty ledger gives no rows."""
    counts = ledger.groupBy("fail_bits").agg(F.count("*").alias("n"))
    plan = F.array(*[F.struct(F.lit(p.version).alias("policy"), F.lit(r).alias("rule"), F.lit(p.mask).cast("long").alias("mask"),
                              F.lit(BIT[r]).cast("long").alias("bit")) for p in policies for r in dict.fromkeys(p.rules)])
    rows = counts.select("fail_bits", "n", F.explode(plan).alias("x")).select("fail_bits", "n", "x.*")
    failed = F.col("fail_bits").bitwiseAND(F.col("mask"))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0)))
    return rows.groupBy("policy", "rule").agg(
        F.sum("n").alias("n_rows"), total(failed != 0).alias("n_rejected"),
        total(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0).alias("n_failing"),
        total(failed == F.col("bit")).alias("n_by_this_alone"))
