"""K7: appending batches of predictions exactly once, by a write manifest.

A batch has an id that its job chooses (the same one when it runs again). Its rows
are written under an attempt of their own, then one small file that names the attempt
is renamed into the manifest folder: that rename is the commit, and it fails if the
batch is there already. Readers follow committed attempts only, so a job that ends
between write and commit leaves nothing to be seen, and a job that runs twice leaves
its rows once. All file work goes through the session's Hadoop file system (on an
object store, whose renames copy, the single small file is still put at once).

    path/batches/<batch>/<attempt>/*.parquet     rows, with model_version
    path/manifest/<batch>.json                   {"batch", "attempt", "model_version"}
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAMES = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.=-]*")
_MANIFEST = "batch string, attempt string, model_version string"


class _Files:
    """The Hadoop file system of a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = path.rstrip("/")
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, name: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.path(name))) if self.exists(name) else []

    def put(self, name: str, text: str) -> None:
        out = self.fs.create(self.path(name), False)
        out.write(text.encode())
        out.close()

    def rename_new(self, old: str, new: str) -> bool:
        """One atomic rename; False if the new name is taken."""
        none = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.jvm.java.lang.reflect.Array.newInstance(none.NONE.getClass(), 1)
        options[0] = none.NONE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        try:
            context.rename(self.path(old), self.path(new), options)
        except Exception as e:  # py4j wraps the file system's exception
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def stage_batch(pred: DataFrame, path: str, batch: str, model_version: str) -> str:
    """Write a batch's rows under a new attempt, which no reader follows yet."""
    if not _NAMES.fullmatch(batch):
        raise ValueError(f"a batch id is of letters, digits and _ . = -: {batch!r}")
    attempt = uuid.uuid4().hex
    pred.withColumn("model_version", F.lit(model_version)).write.parquet(f"{path.rstrip('/')}/batches/{batch}/{attempt}")
    return attempt


def commit_batch(spark: SparkSession, path: str, batch: str, attempt: str, model_version: str) -> bool:
    """Name the attempt in the manifest by one atomic rename. False if the batch was
    committed before; its first attempt stays the one that is read."""
    import json
    files = _Files(spark, path)
    files.fs.mkdirs(files.path("manifest"))
    draft = f"manifest/.{batch}-{attempt}"  # hidden from readers
    files.put(draft, json.dumps({"batch": batch, "attempt": attempt, "model_version": model_version}) + "\n")
    done = files.rename_new(draft, f"manifest/{batch}.json")
    if not done:
        files.delete(draft)
    return done


def write_predictions(pred: DataFrame, path: str, batch: str, model_version: str) -> bool:
    """Append a batch of predictions under a model version. A batch that is committed
    already is not written again (False)."""
    spark = pred.sparkSession
    if _Files(spark, path).exists(f"manifest/{batch}.json"):
        return False
    return commit_batch(spark, path, batch, stage_batch(pred, path, batch, model_version), model_version)


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The manifest: one row a committed batch."""
    if not _Files(spark, path).names("manifest"):
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).option("pathGlobFilter", "*.json").json(f"{path.rstrip('/')}/manifest")


def read_predictions(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all committed batches, with batch and model_version. The driver
    holds one name a batch. No committed batch: no rows."""
    attempts = [f"{path.rstrip('/')}/batches/{r['batch']}/{r['attempt']}" for r in committed(spark, path).collect()]
    fields = f"{schema}, model_version string" if isinstance(schema, str) else schema.add("model_version", "string")
    if not attempts:
        return spark.createDataFrame([], fields).withColumn("batch", F.lit(None).cast("string"))
    rows = spark.read.schema(fields).parquet(*attempts)
    return rows.withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), "/batches/([^/]+)/[^/]+/[^/]+$", 1))


def remove_uncommitted(spark: SparkSession, path: str) -> int:
    """Delete attempts that no manifest names (of ended jobs); returns their number.
    Run it when no job writes."""
    files = _Files(spark, path)
    named = {(r["batch"], r["attempt"]) for r in committed(spark, path).collect()}
    lost = [(b, a) for b in files.names("batches") for a in files.names(f"batches/{b}") if (b, a) not in named]
    for b, a in lost:
        files.delete(f"batches/{b}/{a}")
    return len(lost)
