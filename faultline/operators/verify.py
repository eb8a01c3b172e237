"""Prediction summaries and verification against gold labels
(J4, J5, J7, A6-A10, U3, W4, O3, M7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators.ranks import first_by


def verify(pred: DataFrame, gold: DataFrame, key: str, pred_col: str = "predicted",
           gold_col: str = "gold") -> DataFrame:
    """J4 + M7: join predictions to the first gold label per key (hash join,
    not the original nested loops) and flag agreement."""
    g = first_by(gold, [key], gold_col, [gold_col])
    return (pred.join(g, key, "inner")
                .withColumn("is_correct", F.col(pred_col) == F.col(gold_col)))


def confusion(verified: DataFrame, pred_col: str = "predicted", gold_col: str = "gold") -> DataFrame:
    """A10: counts per (gold, predicted); correct + wrong = joined rows."""
    return verified.groupBy(gold_col, pred_col).agg(
        F.count(F.lit(1)).alias("n"), F.first("is_correct").alias("is_correct"))


def accuracy(verified: DataFrame) -> DataFrame:
    """A10: correct, wrong and accuracy in one row."""
    return verified.agg(F.count_if("is_correct").alias("correct"),
                        F.count_if(~F.col("is_correct")).alias("wrong"),
                        F.try_divide(F.count_if("is_correct").cast("double"),
                                     F.count(F.lit(1))).alias("accuracy"))


def category_summary(pred: DataFrame, cat: str, index: str) -> DataFrame:
    """Per category the count and the index range. The complete list of
    indices is ``category_pairs``, in long form, so no category is collected
    into one row."""
    return pred.groupBy(cat).agg(F.count(F.lit(1)).alias("n"),
                                 F.min(index).alias("first_index"),
                                 F.max(index).alias("last_index"))


def category_pairs(pred: DataFrame, cat: str, index: str) -> DataFrame:
    """The indices of each category, one row each."""
    return pred.select(F.col(cat).alias("category"), F.col(index).alias("index"))


def coverage(tasks: DataFrame, labelled: DataFrame, key: str, cat: str) -> DataFrame:
    """A7 + A8: total tasks, with and without a label, distinct categories.
    ``labelled`` holds one row per labelled key (left-semi side)."""
    flagged = tasks.join(labelled.select(key).distinct().withColumn("_has", F.lit(True)), key, "left")
    return flagged.agg(
        F.count(F.lit(1)).alias("total_tasks"),
        F.count_if(F.col("_has").isNotNull()).alias("tasks_with_labels"),
        F.count_if(F.col("_has").isNull()).alias("tasks_without_labels"),
        F.count_distinct(cat).alias("total_categories"))


def category_by_repo(pred: DataFrame, lookup: DataFrame, key: str, cat: str, repo: str,
                     repos: list[str]) -> DataFrame:
    """Every category x every listed repository, 0 where there
    is no prediction; repositories outside the list are dropped. The key ->
    repo lookup keeps the first match per key. The grid comes from a literal
    list exploded per category (a generator, no cross join)."""
    first = first_by(lookup, [key], repo, [repo])
    counts = (pred.join(first, key, "inner")
                  .where(F.col(repo).isin(repos))
                  .groupBy(cat, repo).agg(F.count(F.lit(1)).alias("n")))
    grid = pred.select(cat).distinct().select(
        cat, F.explode(F.array(*[F.lit(r) for r in repos])).alias(repo))
    return grid.join(counts, [cat, repo], "left").select(cat, repo, F.coalesce("n", F.lit(0)).alias("n"))


def set_membership(left: DataFrame, right: DataFrame, key: str,
                   names=("both", "left_only", "right_only")) -> DataFrame:
    """Intersection and both differences of two key sets: one union with
    flags, one aggregation by key."""
    both = left.select(key, F.lit(True).alias("l"), F.lit(False).alias("r")).unionByName(
        right.select(key, F.lit(False).alias("l"), F.lit(True).alias("r")))
    sides = both.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    name = F.when(F.col("l") & F.col("r"), names[0]).when(F.col("l"), names[1]).otherwise(names[2])
    return sides.select(key, name.alias("membership"))


#: Score bins of ``score_histogram``; scores of one bin are ties.
BINS = 1000


def score_histogram(pred: DataFrame, classes: list[str], probs: str = "class_probs", gold: str = "gold", bins: int = BINS) -> DataFrame:
    """M7: (class, bin, positives, negatives, chosen_positives, chosen_negatives, score):
    of each class and bin of its probability the rows of that class and of others,
    those of them that the class is predicted for (the largest probability, ties: the
    first class in ``classes``), and the sum of the probabilities. Sums only, so
    histograms of parts of the data add up; one row a class and bin at most. Rows
    without a gold class or without probabilities do not count."""
    names = F.array(*[F.lit(c) for c in classes])
    rows = pred.where(F.col(gold).isNotNull() & F.col(probs).isNotNull()).select(F.col(gold).alias("_gold"), F.transform(
        names, lambda c: F.coalesce(F.try_element_at(F.col(probs), c), F.lit(0.0))).alias("_p"))
    each = rows.select("_gold", F.array_position("_p", F.array_max("_p")).alias("_top"), F.posexplode("_p").alias("_i", "p"))
    is_class, chosen = F.col("_gold") == F.element_at(names, F.col("_i") + 1), F.col("_top") == F.col("_i") + 1
    at = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return each.groupBy(F.element_at(names, F.col("_i") + 1).alias("class"), at.alias("bin")).agg(
        F.count_if(is_class).alias("positives"), F.count_if(~is_class).alias("negatives"),
        F.count_if(is_class & chosen).alias("chosen_positives"), F.count_if(~is_class & chosen).alias("chosen_negatives"),
        F.sum("p").alias("score"))


def class_measures(histogram: DataFrame) -> DataFrame:
    """M7: of each class rows, precision, recall, F1, the area under the ROC curve (rows
    of one bin are ties and count half) and the expected calibration error (mean over the
    rows of |share of positives - mean probability| of their bin), all from running sums
    over at most ``BINS`` rows a class. A measure without rows to divide by is NULL."""
    from pyspark.sql import Window
    below = Window.partitionBy("class").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    x = histogram.withColumn("_below", F.coalesce(F.sum("negatives").over(below), F.lit(0)))
    d = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    s = x.groupBy("class").agg(
        F.sum(F.col("positives") + F.col("negatives")).alias("n"), F.sum("positives").alias("pos"), F.sum("negatives").alias("neg"),
        F.sum("chosen_positives").alias("tp"), F.sum("chosen_negatives").alias("fp"),
        F.sum(F.col("positives") * (2 * F.col("_below") + F.col("negatives"))).alias("_area"),
        F.sum(F.abs(F.col("positives") - F.col("score"))).alias("_off"))
    precision, recall = d(F.col("tp"), F.col("tp") + F.col("fp")), d(F.col("tp"), F.col("pos"))
    return s.select("class", "n", F.col("pos").alias("n_class"), F.col("tp").alias("n_correct"), (F.col("tp") + F.col("fp")).alias("n_predicted"),
                    F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"),
                    F.round(d(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("pos")), 6).alias("f1"),
                    F.round(d(F.col("_area"), 2 * F.col("pos") * F.col("neg")), 6).alias("roc_area"),
                    F.round(d(F.col("_off"), F.col("n")), 6).alias("calibration_error"))
