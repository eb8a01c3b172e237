"""Training sets, contrastive pairs and the classifier.

The few-shot encoder of the original is re-aimed: features are a given
embedding column (``array_to_vector``) or hashed token counts with IDF, and
the head is a multinomial logistic regression trained by Spark ML.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators.ranks import positions

# Training profile defaults (head only): iterations and L2 strength.
MAX_ITER = 100
TEXT_FEATURES = 1 << 18  # Spark ML's own default
REG_PARAM = 0.01
TEXT_TOL = 1e-4  # the text head stops when the loss changes by less than this share
PAIR_ITERATIONS = 10


def contrastive_pairs(df: DataFrame, id_col: str, label_col: str, iterations: int = PAIR_ITERATIONS) -> DataFrame:
    """M4: for each example and each j in 1..iterations, one same-label
    partner (target 1) and one other-label partner (target 0).

    Examples are numbered per label in order of id (``positions``). With n
    examples of the label and L labels, the same-label partner is at position
    (p + 1 + (j - 1) mod (n - 1)) mod n, so never the example itself; the
    other label is number (l + 1 + (j - 1) mod (L - 1)) mod L, so never its own,
    and the partner there at (p + j - 1) mod n', so partners of a rare label are
    taken in turn. Partners come by an equi-join on (label, position). A label
    of one example has no positives, one label alone no negatives."""
    pos = positions(df.select(id_col, label_col), [label_col], [id_col], "pos")
    sizes = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    # One row per class: bounded by the number of classes.
    classes = sizes.withColumn("ord", F.row_number().over(Window.orderBy(label_col)) - 1) \
                   .withColumn("n_classes", F.count(F.lit(1)).over(Window.partitionBy()))
    a = pos.join(classes, label_col, "inner").select(
        F.col(id_col).alias("a_id"), F.col(label_col).alias("a_label"), "pos", "n", "ord", "n_classes",
        F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("k"))
    same = a.where(F.col("n") > 1).select(
        "a_id", "k", F.lit(1).alias("target"), F.col("a_label").alias("b_label"),
        F.pmod(F.col("pos") + 1 + F.col("k") % (F.col("n") - 1), F.col("n")).alias("b_pos"))
    other = a.where(F.col("n_classes") > 1).select(
        "a_id", "k", "pos", F.pmod(F.col("ord") + 1 + F.col("k") % (F.col("n_classes") - 1), F.col("n_classes")).alias("b_ord"))
    other = other.join(classes.select(F.col("ord").alias("b_ord"), F.col(label_col).alias("b_label"), F.col("n").alias("b_n")), "b_ord") \
                 .select("a_id", "k", F.lit(0).alias("target"), "b_label", F.pmod(F.col("pos") + F.col("k"), F.col("b_n")).alias("b_pos"))
    partners = pos.select(F.col(label_col).alias("b_label"), F.col("pos").alias("b_pos"), F.col(id_col).alias("b_id"))
    return (same.unionByName(other).join(partners, ["b_label", "b_pos"], "inner")
                .select("a_id", "b_id", "target", (F.col("k") + 1).alias("j")))


#: Classes whose sizes are held as one literal each; more are refused.
MAX_CLASSES = 10_000


def _search(sums: list[int], value):
    """Number of running sums (0, ...) that are at most ``value``, less one: by halving."""
    table = F.expr("array(" + ", ".join(f"{x}L" for x in sums) + ")")
    halves = max(1, len(sums).bit_length())
    span = F.struct(F.lit(0).alias("a"), F.lit(len(sums)).alias("b"))

    def halve(s, _):
        m = F.floor((s["a"] + s["b"]) / 2).cast("int")
        right = (s["b"] - s["a"] > 1) & (F.get(table, m) <= value)
        return F.struct(F.when(right, m).otherwise(s["a"]).alias("a"), F.when(right | (s["b"] - s["a"] <= 1), s["b"]).otherwise(m).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(halves + 1)), span, halve, lambda s: s["a"])


def oversampled_pairs(df: DataFrame, id_col: str, label_col: str, n_pairs: int | None = None) -> DataFrame:
    """M4, second profile: as many same-label pairs (target 1) as other-label pairs
    (target 0), (k, a_id, b_id, target) with k = 0, 1, ... of each target.

    All pairs of a kind are numbered in a closed form: the rows stand in order of
    (label, id); a same-label pair is its class and a place in the triangle of its
    positions, an other-label pair its first row and a row of a later class. Pair k of a
    target is number floor(k P / n) of its P pairs if n <= P, spread over all classes,
    else k mod P, so the rarer kind is repeated evenly. ``n_pairs`` None: the larger
    P, as the original does (it grows with the square of the rows); give a number for
    large tables. Only the class sizes reach the driver; pairs are drawn by ``range`` and
    joined to the rows by position, a unique key. No row is paired with itself; a kind
    without any pair gives none. Rows without a label are left out."""
    rows = df.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"))
    sizes = rows.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).orderBy("_label").limit(MAX_CLASSES + 1).collect()
    if len(sizes) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    n = [r["n"] for r in sizes]
    starts, same, other = [0], [0], [0]
    for x in n:
        starts.append(starts[-1] + x)
    for x, start in zip(n, starts):
        same.append(same[-1] + x * (x - 1) // 2)
        other.append(other[-1] + x * (starts[-1] - start - x))
    wanted = max(same[-1], other[-1]) if n_pairs is None else n_pairs
    spark = df.sparkSession
    longs = lambda xs: F.expr("array(" + ", ".join(f"{x}L" for x in xs) + ")")

    def drawn(sums, target):
        total = sums[-1]
        k = spark.range(wanted if total else 0).withColumnRenamed("id", "k")
        # k P / n in whole numbers of any size.
        number = F.expr(f"CAST(CAST(k AS DECIMAL(20,0)) * {total} div {max(wanted, 1)} AS BIGINT)") if wanted <= total else F.col("k") % max(total, 1)
        x = k.withColumn("q", number).withColumn("c", _search(sums[:-1], F.col("q"))).withColumn("r", F.col("q") - F.get(longs(sums), F.col("c")))
        first = F.get(longs(starts), F.col("c"))
        if target:  # r = j (j - 1) / 2 + i with i < j
            guess = F.floor((1 + F.sqrt(8.0 * F.col("r") + 1)) / 2).cast("long")
            x = x.withColumn("j", guess).withColumn("j", F.when(F.expr("j * (j - 1) div 2 > r"), F.col("j") - 1)
                                                    .when(F.expr("j * (j + 1) div 2 <= r"), F.col("j") + 1).otherwise(F.col("j")))
            a, b = first + F.expr("r - j * (j - 1) div 2"), first + F.col("j")
        else:
            later = F.lit(starts[-1]) - F.get(longs(starts), F.col("c") + 1)
            x = x.withColumn("_w", later)
            a, b = first + F.expr("r div _w"), F.get(longs(starts), F.col("c") + 1) + F.expr("r % _w")
        return x.select("k", F.lit(target).alias("target"), a.alias("a"), b.alias("b"))

    from faultline.operators.ranks import global_positions
    from faultline.session import materialize
    place = materialize(global_positions(rows, [F.col("_label"), F.col("_id")], "_at").select("_id", (F.col("_at") - 1).alias("_at")))
    pairs = drawn(same, 1).unionByName(drawn(other, 0))
    return pairs.join(place.select(F.col("_at").alias("a"), F.col("_id").alias("a_id")), "a").join(
        place.select(F.col("_at").alias("b"), F.col("_id").alias("b_id")), "b").select("k", "a_id", "b_id", "target")


def embedding_classifier(label_col: str = "label", features_col: str = "features",
                         max_iter: int = MAX_ITER, reg_param: float = REG_PARAM, tol: float = 1e-6) -> LogisticRegression:
    """M3 head: multinomial logistic regression."""
    return LogisticRegression(featuresCol=features_col, labelCol=label_col, family="multinomial",
                              maxIter=max_iter, regParam=reg_param, tol=tol)


def with_features(df: DataFrame, embedding_col: str = "embedding") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(embedding_col)))


def text_pipeline(text_col: str = "text", label_col: str = "_label", num_features: int = TEXT_FEATURES,
                  max_iter: int = MAX_ITER) -> Pipeline:
    """M3 alternative for raw text: whitespace tokens -> hashed counts ->
    IDF -> multinomial logistic regression on an indexed label column."""
    tok = RegexTokenizer(inputCol=text_col, outputCol="_tokens", pattern="\\s+")
    tf = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features)
    idf = IDF(inputCol="_tf", outputCol="features")
    return Pipeline(stages=[tok, tf, idf, embedding_classifier(label_col, max_iter=max_iter, tol=TEXT_TOL)])


def fit_text_classifier(train: DataFrame, text_col: str = "text", label_col: str = "label",
                        num_features: int = TEXT_FEATURES) -> tuple[PipelineModel, list[str]]:
    """M3: index the string labels (alphabetical, so runs are repeatable),
    fit the text pipeline, return the model and its class list (one entry
    per class; prediction i is class i). Prediction input needs no label.
    The training rows feed three fits (labels, IDF, regression), so they are
    written once to the checkpoint folder first."""
    from faultline.session import materialize
    train = materialize(train.select(text_col, label_col))
    indexer = StringIndexer(inputCol=label_col, outputCol="_label", stringOrderType="alphabetAsc",
                            handleInvalid="skip").fit(train)
    model = text_pipeline(text_col, "_label", num_features).fit(indexer.transform(train))
    return model, list(indexer.labels)


def predictions(model_output: DataFrame, class_labels=None, digits: int = 3) -> DataFrame:
    """M5 + A12 + A13: confidence = max probability (half-even rounding),
    predicted class, and a class -> probability map."""
    probs = vector_to_array(F.col("probability"))
    out = model_output.withColumn("_p", probs)
    labels = (F.array(*[F.lit(str(c)) for c in class_labels]) if class_labels is not None
              else F.transform(F.sequence(F.lit(0), F.size("_p") - 1), lambda i: i.cast("string")))
    return (out.withColumn("predicted", F.col("prediction").cast("int"))
               .withColumn("confidence", F.bround(F.array_max("_p"), digits))
               .withColumn("class_probs", F.map_from_arrays(labels, F.col("_p")))
               .drop("_p"))


def save_model(model, path: str) -> None:
    """M6: persist a fitted model."""
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    """M6: load a fitted pipeline."""
    return PipelineModel.load(path)
