"""The training-data pipeline: quality rules, line dedup, SimHash near-duplicates,
benchmark decontamination, best-fit packing.

Each stage is a function (spark, docs, sf_dir) that returns a DataFrame; ``run``
writes each stage's rows to the shared folder and rereads them as the next one's
docs. All stages but the last return the columns of ``documents``. Null or empty
texts fail the quality rules; an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultline.llm import decontam, linededup, packing, quality, simhash
from faultline.llm.common import documents, stage


def _has_words(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    ledger = quality.evaluate(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text"))
    return quality.apply_policy(ledger, quality.STRICT).where("kept").select("doc.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go, and of shorter ones with ``linededup.WORDS`` words; documents that have no words left go too."""
    return _has_words(linededup.dedup_lines(docs, words=linededup.WORDS))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the least doc_id (a null after
    all others), of those the one with the least text key, once. Groups go by that
    pair as their name, so groups without ids and groups that share an id stay
    apart. Which rows stay is settled on keys; the texts move once."""
    keyed = docs.withColumn("__key", linededup.document_key("doc_id"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__key").alias("key"))
    member = simhash.near_duplicates(keyed.select(place.alias("doc_id"), "text"))
    least = member.select(F.col("component_id.key").alias("__key")).distinct()
    # Merge join at every size, and the window on its key: one exchange of the texts.
    one = W.partitionBy("__key").orderBy(F.col("doc_id").asc_nulls_last())
    stays = keyed.join(least.hint("merge"), "__key", "left_semi").withColumn("__n", F.row_number().over(one)).where("__n = 1")
    return stays.select(*[F.col(f"`{c}`") for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that have no words left go."""
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    others = F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("__doc")
    cut = decontam.remove_spans(decontam.find(docs.select("text", others), benchmark))
    return _has_words(cut).select(*[F.col("text") if c == "text" else F.col(f"__doc.`{c}`") for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece, with its sequence and offset."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Token ids and links of fingerprints are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
