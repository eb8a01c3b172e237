"""Registered queries: training/prediction sets, classification and
verification (entries B and C1-C3 of the original pipeline).

Stand-ins: ``documents`` are the tasks (``source`` is the repository),
``labels.quality`` is the gold label, a fixed rule on ``documents`` is the
prediction, ``embeddings`` carry features and classes for the classifier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.text import SEGMENT_SEPARATOR, clean_tokens
from faultline.operators import classify as M
from faultline.operators import projection as P
from faultline.operators import verify as V
from faultline.operators.ranks import first_by
from faultline.sources.tables import pinned, spread, table

# Prediction rule on the stand-in tasks: long documents are predicted good.
PRED_MIN_CHARS = 300
# Repository list (the fixed dimension); other sources are dropped.
REPOS = [f"src{i}" for i in range(10)]


def _gold(spark, sf_dir) -> DataFrame:
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return lab.select("doc_id", F.concat(F.lit("quality_"), F.col("quality").cast("string")).alias("gold"))


def _predicted(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return docs.select("doc_id", F.when(F.col("n_chars") >= PRED_MIN_CHARS, F.lit("quality_1"))
                                  .otherwise(F.lit("quality_0")).alias("predicted"))


def _task_text(spark, sf_dir) -> DataFrame:
    """T10 on a document: message (first line) then description (the rest),
    empty bags skipped; NULL when nothing is left (F7)."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    msg = clean_tokens(F.substring_index("text", "\n", 1))
    rest = clean_tokens(F.when(F.instr("text", "\n") > 0,
                               F.expr("substring(text, instr(text, '\\n') + 1)")).otherwise(F.lit("")))
    # Two projections: the token bags are computed once, then reused.
    segs = docs.select("doc_id", pinned(F.filter(F.array(F.array_join(msg, " "), F.array_join(rest, " ")),
                                                 lambda s: s != "")).alias("segs"))
    return segs.select("doc_id", F.when(F.size("segs") > 0,
                                        F.array_join("segs", SEGMENT_SEPARATOR)).alias("text"))


def verify_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4 O3 M7."""
    return V.verify(_predicted(spark, sf_dir), _gold(spark, sf_dir), "doc_id")


def confusion_counts(spark, sf_dir):
    """A10."""
    return V.confusion(verify_predictions(spark, sf_dir))


def category_summary(spark, sf_dir):
    """A6."""
    return V.category_summary(_predicted(spark, sf_dir), "predicted", "doc_id")


def coverage_summary(spark, sf_dir):
    """A7 A8 F14."""
    return V.coverage(_predicted(spark, sf_dir), _gold(spark, sf_dir), "doc_id", "predicted")


def category_by_repo(spark, sf_dir):
    """The category x repository count table (the printed
    report of the original is this result)."""
    lookup = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("repo"))
    return V.category_by_repo(_predicted(spark, sf_dir), lookup, "doc_id", "predicted", "repo", REPOS)


def label_set_ops(spark, sf_dir):
    """U3."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    lab = table(spark, sf_dir, "labels").select("doc_id")
    return V.set_membership(docs, lab, "doc_id", ("both", "documents_only", "labels_only"))


def train_set(spark, sf_dir):
    """Labelled tasks with their text and first label."""
    g = first_by(_gold(spark, sf_dir), ["doc_id"], "gold", ["gold"])
    t = _task_text(spark, sf_dir).where(F.col("text").isNotNull())
    return t.join(g, "doc_id", "inner").select("doc_id", "text", F.col("gold").alias("label"))


def predict_set(spark, sf_dir):
    """Unlabelled tasks with their text."""
    t = _task_text(spark, sf_dir).where(F.col("text").isNotNull())
    return t.join(_gold(spark, sf_dir), "doc_id", "left_anti")


def contrastive_pairs(spark, sf_dir):
    """M4: bounded same/other-label pairs over the embedding table."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return M.contrastive_pairs(emb, "vec_id", "label")


#: Pairs of each target that ``oversampled_pairs`` draws for a row of the table.
PAIRS_A_ROW = 10


def oversampled_pairs(spark, sf_dir):
    """M4, second profile: equal numbers of same- and other-label pairs over the embedding table."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return M.oversampled_pairs(emb, "vec_id", "label", PAIRS_A_ROW * emb.count())


def class_measures(spark, sf_dir):
    """M7: measures of each class of the gold labels, by the probability that a
    document's length gives (half at ``PRED_MIN_CHARS``)."""
    good = F.col("n_chars") / (F.col("n_chars") + F.lit(float(PRED_MIN_CHARS)))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.create_map(F.lit("quality_0"), 1 - good, F.lit("quality_1"), good).alias("class_probs"))
    return V.class_measures(V.score_histogram(docs.join(_gold(spark, sf_dir), "doc_id"), ["quality_0", "quality_1"]))


def _cross_predictions(spark, sf_dir) -> DataFrame:
    """Two folds by vec_id; each is predicted by a head that is
    fitted on the other, so every row is predicted and none by its own label."""
    emb = M.with_features(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    emb = emb.withColumn("fold", F.pmod("vec_id", F.lit(2)))
    out = None
    for fold in (0, 1):
        model = M.embedding_classifier("label").fit(emb.where(F.col("fold") != fold))
        part = M.predictions(model.transform(emb.where(F.col("fold") == fold)))
        out = part if out is None else out.unionByName(part)
    return out


def classify_embeddings(spark, sf_dir):
    """Class, confidence and class probabilities of every row."""
    out = _cross_predictions(spark, sf_dir)
    return out.select("vec_id", "label", "predicted", "confidence", F.to_json("class_probs").alias("class_probs"))


def classify_checks(spark, sf_dir):
    """A12 A13 on all predictions: rows, rows whose probabilities sum to 1,
    whose predicted class has the largest, and whose confidence is that one."""
    return _consistent(_cross_predictions(spark, sf_dir))


def _consistent(predictions: DataFrame) -> DataFrame:
    p = predictions.withColumn("p", F.map_values("class_probs"))
    top = F.array_max("p")
    return p.agg(F.count("*").alias("n_rows"), F.count_if(F.abs(F.aggregate("p", F.lit(0.0), lambda a, x: a + x) - 1) < 1e-9).alias("n_sum_one"),
                 F.count_if(F.element_at("class_probs", F.col("predicted").cast("string")) == top).alias("n_argmax"),
                 F.count_if(F.col("confidence") == F.bround(top, 3)).alias("n_maximum"))


#: Pairs of each target a row, and rounds, of the projection that the registered query fits.
PROJECTION_PAIRS, PROJECTION_ROUNDS = 2, 5


def projection_checks(spark, sf_dir):
    """M3 M4: two folds by vec_id; each is predicted by a head on the projection that the
    other fold's pairs have taught. Rows, rows that are consistent as in
    ``classify_checks``, and folds whose loss fell in every round."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label").withColumn("fold", F.pmod("vec_id", F.lit(2)))
    out, falling = None, 0
    for fold in (0, 1):
        train = emb.where(F.col("fold") != fold)
        pairs = P.pair_vectors(M.contrastive_pairs(train.select("vec_id", "label"), "vec_id", "label", PROJECTION_PAIRS), train, "vec_id", "embedding")
        matrix, losses = P.fit_projection(pairs, PROJECTION_ROUNDS)
        falling += len(losses) > 1 and all(b < a for a, b in zip(losses, losses[1:]))
        model = M.embedding_classifier("label").fit(P.project(train, matrix))
        part = M.predictions(model.transform(P.project(emb.where(F.col("fold") == fold), matrix)))
        out = part if out is None else out.unionByName(part)
    return _consistent(out).withColumn("n_falling", F.lit(falling).cast("long"))


def prediction_accuracy(spark, sf_dir):
    """A10 M7: correct, wrong and accuracy of the stand-in rule."""
    return V.accuracy(verify_predictions(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


def task_category_pairs(spark, sf_dir):
    """Every (category, index) of the predictions."""
    return V.category_pairs(_predicted(spark, sf_dir), "predicted", "doc_id")


def classify_tasks(spark, sf_dir):
    """Fit hashed-token features + IDF + multinomial
    logistic regression on the labelled task texts, then label the
    unlabelled tasks with class, confidence and per-class probabilities.
    The class list comes from the fitted label index (one entry per class)."""
    model, classes = M.fit_text_classifier(train_set(spark, sf_dir), "text", "label")
    out = M.predictions(model.transform(predict_set(spark, sf_dir)), class_labels=classes)
    names = F.array(*[F.lit(c) for c in classes])
    return out.select("doc_id", F.element_at(names, F.col("predicted") + 1).alias("predicted_label"),
                      "confidence", F.to_json("class_probs").alias("class_probs"))
