"""Incremental ingest of commit records dropped into a watched folder.

``readStream`` of ``*.json`` files with the fixed record schema ->
``dropDuplicates(["commit_index"])`` (state is one key per commit, kept in
the checkpoint, so a re-delivered file is ignored) -> the same Column
functions as batch -> append to Parquet. ``availableNow`` processes what is
there and stops, so it runs as a scheduled batch too. For very large key
sets, use the RocksDB state store provider.

With a ``horizon`` the state is bounded: the event time is the file's modification
time, a key is forgotten once the watermark (the latest time seen, less the horizon)
passes it, a copy inside the horizon is dropped, and a file that comes later than the
horizon is dropped and counted (``state_counts``), not lost silently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators.records import record_text
from faultline.session import checkpoint_dir
from faultline.sources.readers import COMMIT_RECORD_SCHEMA


#: Files older than this against the newest one are not listed at all; keep it above any horizon.
MAX_FILE_AGE = "3650d"


def record_stream(spark: SparkSession, src_dir: str, max_files_per_trigger: int = 1000) -> DataFrame:
    return (spark.readStream.schema(COMMIT_RECORD_SCHEMA)
            .option("multiLine", True).option("pathGlobFilter", "*.json")
            .option("maxFilesPerTrigger", max_files_per_trigger)
            .option("maxFileAge", MAX_FILE_AGE)
            .json(src_dir))


def drop_copies(stream: DataFrame, keys: list[str], horizon: str | None) -> DataFrame:
    """Rows of keys that were not seen before, ever (no horizon) or within the horizon
    of the files' modification times."""
    if horizon is None:
        return stream.dropDuplicates(keys)
    timed = stream.withColumn("_modified", F.col("_metadata.file_modification_time")).withWatermark("_modified", horizon)
    return timed.dropDuplicatesWithinWatermark(keys).drop("_modified")


def state_counts(query) -> dict:
    """Of a finished run: rows in, keys held at its end, copies dropped, and rows that came too late."""
    runs = [p for p in query.recentProgress if p["stateOperators"]]
    ops = [p["stateOperators"][0] for p in runs]
    return {"rows_in": sum(p["numInputRows"] for p in runs), "keys_held": ops[-1]["numRowsTotal"] if ops else 0,
            "copies": sum(o["customMetrics"].get("numDroppedDuplicateRows", 0) for o in ops),
            "late": sum(o["numRowsDroppedByWatermark"] for o in ops)}


def flatten_records(records: DataFrame) -> DataFrame:
    """Batch and stream share this projection: key, URL and the T10 text."""
    rec = F.struct("commit", "pull_requests", "issues", "security")
    return records.select("commit_index", "commit_url", record_text(rec).alias("text"))


def ingest(spark: SparkSession, src_dir: str, out_dir: str, name: str = "records",
           checkpoint: str | None = None, horizon: str | None = None, max_files_per_trigger: int = 1000):
    """Run the ingest until the folder is drained; returns the finished query.
    ``horizon`` (e.g. '30 days') bounds the state; a checkpoint keeps to one choice."""
    ckpt = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/ingest-{name}"
    out = flatten_records(drop_copies(record_stream(spark, src_dir, max_files_per_trigger), ["commit_index"], horizon))
    q = (out.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", ckpt)
         .trigger(availableNow=True)
         .start(out_dir))
    q.awaitTermination()
    return q


def dedup_stream(spark: SparkSession, src_dir: str, glob: str, schema, key: F.Column, out_dir: str,
                 name: str, select: list[str] | None = None, checkpoint: str | None = None):
    """Generic X1: a file stream (Parquet) of ``glob`` under ``src_dir``,
    exact duplicates dropped on a content key (e.g. ``sha2(text, 256)``;
    a full hash, so distinct rows are never merged), appended to Parquet.
    State holds one key per distinct row and lives in the checkpoint."""
    ckpt = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/dedup-{name}"
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", glob)
              .option("maxFilesPerTrigger", 1000).parquet(src_dir))
    out = stream.withColumn("_key", key).dropDuplicates(["_key"]).drop("_key")
    if select:
        out = out.select(*select)
    q = (out.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start(out_dir))
    q.awaitTermination()
    return q
