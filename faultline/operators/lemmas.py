"""T7 with a lexicon: noun lemmas of a corpus's distinct tokens.

The vocabulary is looked at once: suffix rules propose stems of each distinct token,
and a stem is taken only if the lexicon holds it, so ``buses`` becomes ``bus`` and
``bias`` stays. Irregular forms come from a table of their own and end the rules for
that form. The result is mapped back to texts by token. Lexicon and irregular forms are
parameters (two tables, of any size).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# The standard noun suffix rules, suffix and what takes its place.
NOUN_RULES = [("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y")]
# ---------------------------------------------------------------------------
#: How often the rules are applied to their own results before a token is given up.
LEVELS = 3
#: Changed tokens up to this number are sent to every task; more are joined by a shuffle.
MAX_BROADCAST = 200_000


def stems(token: Column) -> Column:
    """What the rules make of a token, in their order."""
    made = [F.when(token.endswith(suffix) & (F.length(token) + len(by) > len(suffix)),
                   F.concat(F.substring(token, 1, F.length(token) - len(suffix)), F.lit(by))) for suffix, by in NOUN_RULES]
    return F.array_compact(F.array(*made))


def lemma_table(vocabulary: DataFrame, lexicon: DataFrame, irregular: DataFrame | None = None) -> DataFrame:
    """(token, lemma) of each distinct token of ``vocabulary`` (token).

    ``lexicon`` is (word), ``irregular`` (form, lemma). Of a token that has irregular
    lemmas these and itself are proposed, of others itself and the stems of the rules; of
    those that the lexicon holds the shortest is taken (ties: the earlier proposal). If it
    holds none, the stems' own stems are tried, ``LEVELS`` deep; a token without any
    accepted proposal stays as it is. Null tokens are left out."""
    tokens = vocabulary.select("token").where("token IS NOT NULL").distinct()
    held = lexicon.select(F.col("word").alias("proposal")).where("proposal IS NOT NULL").distinct()
    levels, last = [F.struct(F.lit(0).alias("level"), F.array("token").alias("words"))], F.array("token")
    for level in range(LEVELS):
        last = F.array_distinct(F.flatten(F.transform(last, stems)))
        levels.append(F.struct(F.lit(level).alias("level"), last.alias("words")))
    proposed = tokens
    if irregular is not None:
        forms = irregular.where("form IS NOT NULL AND lemma IS NOT NULL").groupBy(F.col("form").alias("token")).agg(F.sort_array(F.collect_set("lemma")).alias("known"))
        proposed = tokens.join(forms, "token", "left")
        own = F.array(F.struct(F.lit(0).alias("level"), F.concat(F.array("token"), F.col("known")).alias("words")))
        choice = F.when(F.col("known").isNotNull(), own).otherwise(F.array(*levels))
    else:
        choice = F.array(*levels)
    each = proposed.select("token", F.explode(F.flatten(F.transform(choice, lambda x, i: F.transform(x["words"], lambda w, k: F.struct(
        x["level"].alias("level"), F.length(w).alias("size"), (i * 100 + k).alias("turn"), w.alias("word")))))).alias("p"))
    best = each.join(held, each["p.word"] == held["proposal"], "left_semi").groupBy("token").agg(F.min("p").alias("p")).select("token", F.col("p.word").alias("lemma"))
    return tokens.join(best, "token", "left").select("token", F.coalesce("lemma", "token").alias("lemma"))


def with_lemmas(df: DataFrame, key: str, tokens: str, table: DataFrame) -> DataFrame:
    """(key, tokens) with each token replaced by its lemma in ``table`` (token, lemma).
    Only changed tokens are joined; they are broadcast if ``MAX_BROADCAST`` at most, else
    the join shuffles. Rows are dealt once by their number; a broadcast lookup and the
    regrouping of a row's tokens stay in that partitioning, so texts move once. Order and
    repeats stay; a null or empty array stays. ``df`` is a stored table: its rows get the
    same numbers when a task runs again."""
    changed = table.where("token != lemma")
    n = changed.limit(MAX_BROADCAST + 1).count()
    rows = df.select(F.col(key).alias("_key"), F.col(tokens).alias("_tokens"), F.monotonically_increasing_id().alias("_row")).repartition("_row")
    each = rows.select("_row", "_key", F.col("_tokens").isNull().alias("_none"), F.posexplode_outer("_tokens").alias("_at", "token"))
    mapped = each.join(F.broadcast(changed) if n <= MAX_BROADCAST else changed, "token", "left")
    item = F.when(F.col("_at").isNotNull(), F.struct("_at", F.coalesce("lemma", "token").alias("t")))
    back = mapped.groupBy("_row").agg(F.first("_key").alias("_key"), F.first("_none").alias("_none"), F.sort_array(F.collect_list(item)).alias("l"))
    return back.select(F.col("_key").alias(key), F.when(~F.col("_none"), F.transform("l", lambda x: x["t"])).alias(tokens))
