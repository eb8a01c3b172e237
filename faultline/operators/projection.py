"""M3: a linear projection of embeddings learned on contrastive pairs.

The body of the original's training: pairs of one label should point the same way,
pairs of two labels should not. The loss of a projection W is the mean over the pairs
of (cosine of W a and W b - target)^2. Every round takes the gradient over all pairs and
the losses of a few step lengths along it, each as one pass in which a partition adds
up its pairs; the sums meet in a tree, and only the matrix and its gradient reach the
driver. The best step is taken if the loss falls, else the steps shrink; rounds end
after ``rounds`` or when no step helps. A head is fitted on the projected vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.session import materialize

#: Partial sums that meet in one task, and step lengths that a round tries (times the last good one).
FAN = 64
STEPS = (8.0, 4.0, 2.0, 1.0, 0.5, 0.25)


def pair_vectors(pairs: DataFrame, vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(a, b, target) of (a_id, b_id, target) pairs: their vectors, written once."""
    v = vectors.select(F.col(id_col).alias("_id"), F.col(vector).cast("array<float>").alias("_v")).where("_v IS NOT NULL")
    side = lambda name: v.select(F.col("_id").alias(f"{name}_id"), F.col("_v").alias(name))
    return materialize(pairs.select("a_id", "b_id", F.col("target").cast("float").alias("target"))
                       .join(side("a"), "a_id").join(side("b"), "b_id").select("a", "b", "target"))


def _losses(w: np.ndarray, a: np.ndarray, b: np.ndarray, target: np.ndarray):
    """Loss of each pair and its gradients by the two projected vectors; a pair with a
    zero vector has a cosine of 0 and no gradient."""
    u, v = a @ w, b @ w
    nu, nv = np.linalg.norm(u, axis=1), np.linalg.norm(v, axis=1)
    live = (nu > 0) & (nv > 0)
    nu, nv = np.where(live, nu, 1), np.where(live, nv, 1)
    cos = np.where(live, (u * v).sum(axis=1) / (nu * nv), 0)
    off = cos - target
    slope = np.where(live, 2 * off, 0)[:, None]
    du = slope * (v / (nu * nv)[:, None] - cos[:, None] * u / (nu ** 2)[:, None])
    dv = slope * (u / (nu * nv)[:, None] - cos[:, None] * v / (nv ** 2)[:, None])
    return off ** 2, du, dv


def _summed(pairs: DataFrame, measure) -> np.ndarray:
    """The sum over all pairs of an array that is measured on batches of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                rows = [batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64) for c in ("a", "b")]
                part = measure(*rows, batch.column("target").to_numpy().astype(np.float64))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())],
                                             names=["part", "total"])

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        total = sum(np.frombuffer(x) for x in table["total"].to_pylist())
        return pa.table({"part": pa.array([table["part"][0].as_py() // FAN], pa.int64()), "total": pa.array([total.tobytes()], pa.binary())})

    sums, parts = pairs.mapInArrow(run, "part long, total binary"), pairs.rdd.getNumPartitions()
    while parts > FAN:
        sums = sums.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(merge, "part long, total binary")
        parts = -(-parts // FAN)
    return sum(np.frombuffer(bytes(x)) for _, x in sorted((r["part"], r["total"]) for r in sums.collect()))  # FAN rows at most


def fit_projection(pairs: DataFrame, rounds: int = 15, rank: int | None = None, seed: int = 0) -> tuple[np.ndarray, list[float]]:
    """(matrix, losses) from (a, b, target) pairs of equally long vectors: the loss before
    the first round and after each one, falling. It starts from the identity, or from
    ``rank`` orthonormal columns."""
    first = pairs.select("a").first()
    if first is None:
        raise ValueError("no pairs to learn from")
    dim = len(first["a"])
    w = np.eye(dim) if rank is None else np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, rank)))[0]
    losses, reach = [], 1.0
    for _ in range(rounds):
        def slope(a, b, target, w=w):
            loss, du, dv = _losses(w, a, b, target)
            return np.concatenate([[len(a), loss.sum()], (a.T @ du + b.T @ dv).ravel()])
        found = _summed(pairs, slope)
        n, gradient = found[0], found[2:].reshape(w.shape) / found[0]
        if not losses:
            losses.append(float(found[1] / n))
        size = np.linalg.norm(gradient)
        if size == 0:
            break
        # Steps as a share of the matrix: the cosine does not change with its scale.
        steps = [reach * s * 0.1 * np.linalg.norm(w) / size for s in STEPS]
        tried = [w - s * gradient for s in steps]
        got = _summed(pairs, lambda a, b, target: np.array([_losses(x, a, b, target)[0].sum() for x in tried])) / n
        best = int(np.argmin(got))
        if got[best] < losses[-1]:
            w, reach = tried[best], reach * STEPS[best]
            losses.append(float(got[best]))
        else:
            reach *= STEPS[-1] / STEPS[0]
            if reach < 1e-6:
                break
    return w / np.linalg.norm(w) * np.sqrt(w.shape[1]), losses


def project(df: DataFrame, matrix: np.ndarray, vector: str = "embedding", out: str = "features") -> DataFrame:
    """All columns and the projected vector; a null vector stays null."""
    rows = F.expr("array(" + ", ".join("array(" + ", ".join(f"{x!r}D" for x in row) + ")" for row in matrix.T.tolist()) + ")")
    x = F.col(vector).cast("array<double>")
    dot = lambda row: F.aggregate(F.zip_with(x, row, lambda p, q: p * q), F.lit(0.0), lambda s, y: s + y)
    return df.withColumn(out, F.when(x.isNotNull(), array_to_vector(F.transform(rows, dot))))
