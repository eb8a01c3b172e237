"""The registered queries: each applies one operator, with production
parameters, to its whole table and derives the digest columns from its output."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import bpe, decontam, doubling, license, linededup, packing, quality, secrets, simhash, spelling, suffix, warc, whitening
from faultline.llm.common import documents


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality.evaluate(documents(spark, sf_dir).select("doc_id", "text"))
    return quality.apply_policy(ledger.drop("text"), quality.STRICT)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    found = decontam.find(documents(spark, sf_dir).select("doc_id", "text"), benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir).select("doc_id", "text"))
    number = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[number(k) for k in secrets.FIXED], F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"),
                        secrets.joined(F.sort_array(F.concat("base", "added"))).alias("spans"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_bytes(documents(spark, sf_dir).select("doc_id", "text")).drop("spans")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubling.repeated_words(documents(spark, sf_dir).select("doc_id", "text"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_report(documents(spark, sf_dir).select("doc_id", "text"), words=linededup.WORDS)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(documents(spark, sf_dir).select("doc_id", "text"))


def page_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures derived from ``pages``: each page is a full response, a day a
    page id after the first; a day later a revisit of the same URL by another
    spelling, with the page's validator (every fifth: a changed one, every
    seventh: a date alone); and a revisit a day before the response."""
    pages = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet").select("page_id", "url", F.md5("html").alias("digest"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 1000).cast("int"))
    header = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])
    text = day.cast("string")

    def capture(step: int, kind: str, date, url, etag, modified, headers):
        return F.struct((F.col("page_id") * 3 + step).alias("record_id"), url.alias("url"), date.cast("timestamp").alias("date"),
                        F.lit(kind).alias("kind"), etag.alias("etag"), modified.alias("last_modified"), headers.alias("headers"))
    url, digest, none = F.col("url"), F.col("digest"), F.lit(None).cast("string")
    seventh, fifth = F.col("page_id") % 7 == 0, F.col("page_id") % 5 == 0
    rows = F.array(
        capture(0, "revisit", F.date_sub(day, 1), url, digest, none, header("etag", digest)),
        capture(1, "response", day, url, digest, text, header("etag", digest, "content-type", "text/html", "cache-control", "max-age=60", "date", text)),
        capture(2, "revisit", F.date_add(day, 1), F.concat(url, F.when(url.contains("?") | url.contains("#"), "").otherwise("?utm_source=x")),
                F.when(~seventh, F.when(fifth, F.concat(digest, F.lit("0"))).otherwise(F.concat(F.lit("W/"), digest))), text,
                header("cache-control", "max-age=120", "content-type", "text/plain", "date", F.date_add(day, 1).cast("string"))))
    return pages.select(F.explode(rows).alias("x")).select("x.*")


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = warc.resolve(page_captures(spark, sf_dir))
    fields = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return done.select("record_id", "canonical", "status", "refers_to", F.date_format("refers_to_date", "yyyy-MM-dd").alias("refers_to_date"),
                       F.when(F.col("headers").isNotNull(), F.array_join(fields, ";")).alias("headers"))


def op11_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), path, decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir).select("doc_id", "text"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"))
