"""Whitening of embeddings by a block Jacobi-Davidson iteration.

The covariance is never formed: it is applied to a block of vectors in one pass over
the rows, ``sum(xc (xc . y)) / n``, where each row is centred before it is multiplied
(the whole part of the mean is taken off in integers, the rest as a double). Tasks add
up their blocks; their sums meet in a tree in the order of the tasks.

The driver holds the search space only (dimensions x a few times ``components``).
Each round takes the Ritz pairs of the space, locks those whose residual reached
double precision (in falling order), and solves the projected correction equation of
all others together by a few steps of MINRES, one distributed product a step. The
corrections widen the space; a space that is too wide shrinks to its best Ritz vectors.

Entries become whole numbers x = floor(64 c) + 1000000; the fit list is each distinct
x vector once. It is packed into blocks of at most ``BLOCK`` bytes in the narrowest
integers that hold them, and written once to the shared folder.

Defined results: rows whose vector is null or holds null or non-finite entries (or such
that x is no long) give no rows, likewise rows whose vector has another length than
most (ties: than the longest) vectors. Repeated rows and null ids are whitened each.
Components without variance (an eigenvalue at rounding level) have no whitened value
and are left out; so a table of one distinct vector or none gives no rows. A deviation
that is no long is null. Of either sign of a component the one with a positive largest
coordinate is taken.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import stage

SCALE, SHIFT = 64, 1_000_000
#: Bytes of a block of the fit list (as doubles), and partial sums that meet in one task.
BLOCK, FAN = 8 << 20, 64
#: Vectors of the first search space beyond the components, MINRES steps of a round, rounds at most.
GUARD, STEPS, ROUNDS = 4, 4, 200
EPS = float(np.finfo(np.float64).eps)
WIDTHS = (np.int8, np.int16, np.int32, np.int64)


# ----------------------------------------------------------------- vectors

def whole_vectors(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, x array<long>) of the rows that have a vector; x is without SHIFT."""
    values = F.col(f"`{vector}`").cast("array<double>")
    fits = F.forall(values, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float(1 << 62) / SCALE)))
    x = F.transform(values, lambda c: F.floor(c * SCALE).cast("long"))
    return table.where(values.isNotNull() & F.coalesce(fits, F.lit(False))).select(F.col(f"`{key}`").alias("key"), x.alias("x"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim)


def narrowest(low: int, high: int):
    return next(i for i, t in enumerate(WIDTHS) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)


def _packed_rows(dim: int):
    """Each vector as bytes in the narrowest integers for it: equal vectors have equal bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), dim)
            out = np.empty(len(x), dtype=object)
            width = np.zeros(len(x), np.int64)
            for i, t in enumerate(WIDTHS[:-1]):
                width[(x.min(axis=1) < np.iinfo(t).min) | (x.max(axis=1) > np.iinfo(t).max)] = i + 1
            for i, t in enumerate(WIDTHS):
                rows = np.flatnonzero(width == i)
                data = x[rows].astype(t).tobytes()
                step = dim * np.dtype(t).itemsize
                out[rows] = [data[k * step: (k + 1) * step] for k in range(len(rows))]
            yield pa.RecordBatch.from_arrays([pa.array(out.tolist(), pa.binary())], names=["v"])
    return run


def _blocks(dim: int):
    """Distinct packed vectors to blocks of vectors of one width."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, BLOCK // (8 * dim))
        held: dict[int, list[bytes]] = {i: [] for i in range(len(WIDTHS))}
        whole = lambda i, rows: pa.RecordBatch.from_arrays(
            [pa.array([i], pa.int32()), pa.array([b"".join(rows)], pa.binary())], names=["width", "block"])
        for batch in batches:
            for v in batch.column("v").to_pylist():
                i = (len(v) // dim).bit_length() - 1
                held[i].append(v)
                if len(held[i]) == most:
                    yield whole(i, held[i])
                    held[i] = []
        for i, rows in held.items():
            if rows:
                yield whole(i, rows)
    return run


class FitList:
    """The distinct vectors in blocks, their number n, their sums, and their centred products."""

    def __init__(self, vectors: DataFrame, dim: int):
        self.dim = dim
        distinct = vectors.select("x").mapInArrow(_packed_rows(dim), "v binary").distinct()
        self.blocks = stage(distinct.mapInArrow(_blocks(dim), "width int, block binary"))
        # Sums in limbs of 21 bits: exact for 2^42 vectors.
        limbs = self._sum(lambda x: np.concatenate([[len(x)], (x & 0x1FFFFF).sum(axis=0), (x >> 21 & 0x1FFFFF).sum(axis=0), (x >> 42).sum(axis=0)]), np.int64)
        limbs = np.zeros(1 + 3 * dim, np.int64) if limbs is None else limbs
        self.n = int(limbs[0])
        low, middle, high = (limbs[1 + i * dim: 1 + (i + 1) * dim].tolist() for i in range(3))
        self.sums = [a + (b << 21) + (c << 42) for a, b, c in zip(low, middle, high)]
        self.whole = np.array([s // self.n if self.n else 0 for s in self.sums], np.int64)
        #: n times what the mean is above its whole part.
        self.rest = [s - self.n * int(w) for s, w in zip(self.sums, self.whole)]
        self.part = np.array([r / self.n if self.n else 0.0 for r in self.rest])

    def _sum(self, measure: Callable[[np.ndarray], np.ndarray], kind) -> np.ndarray | None:
        """The sum of an array that is measured on each block."""
        dim = self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for i, data in zip(batch.column("width").to_pylist(), batch.column("block").to_pylist()):
                    part = measure(np.frombuffer(data, WIDTHS[i]).reshape(-1, dim).astype(np.int64))
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.astype(kind).tobytes()], pa.binary())],
                                                 names=["part", "total"])

        def merge(table: pa.Table) -> pa.Table:
            table = table.sort_by("part")
            total = sum(np.frombuffer(x, kind) for x in table["total"].to_pylist())
            return pa.table({"part": pa.array([table["part"][0].as_py() // FAN], pa.int64()), "total": pa.array([total.tobytes()], pa.binary())})

        sums, parts = self.blocks.mapInArrow(run, "part long, total binary"), self.blocks.rdd.getNumPartitions()
        while parts > FAN:
            sums = sums.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(merge, "part long, total binary")
            parts = -(-parts // FAN)
        rows = sorted((r["part"], bytes(r["total"])) for r in sums.collect())  # FAN at most
        return sum(np.frombuffer(x, kind) for _, x in rows) if rows else None

    def centred(self) -> Callable[[np.ndarray], np.ndarray]:
        whole, part = self.whole, self.part
        return lambda x: (x - whole).astype(np.float64) - part

    def product(self, y: np.ndarray) -> np.ndarray:
        """The covariance applied to the columns of y."""
        centred, shape = self.centred(), y.shape

        def measure(x):
            c = centred(x)
            return (c.T @ (c @ y)).ravel()
        return self._sum(measure, np.float64).reshape(shape) / self.n

    def trace(self) -> float:
        centred = self.centred()
        return float(self._sum(lambda x: np.array([(centred(x) ** 2).sum()]), np.float64)[0]) / self.n

    def identity_error(self, w: np.ndarray) -> float:
        """The largest entry of the covariance of the fit list times w, less the identity."""
        centred, k = self.centred(), w.shape[1]

        def measure(x):
            z = centred(x) @ w
            return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])
        found = self._sum(measure, np.float64) / self.n
        return float(np.abs(found[k:].reshape(k, k) - np.outer(found[:k], found[:k]) - np.eye(k)).max())


# --------------------------------------------------------- Jacobi-Davidson

def orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """The columns of new made orthonormal to each other and to all others; those that depend on them go."""
    fixed = np.concatenate(against, axis=1) if against else np.zeros((len(new), 0))
    kept = np.zeros((len(new), 0))
    for v in new.T:
        size = np.linalg.norm(v)
        if not size:
            continue
        v = v / size
        for _ in range(3):
            v = v - fixed @ (fixed.T @ v)
            v = v - kept @ (kept.T @ v)
        size = np.linalg.norm(v)
        if size > 1e-10:
            v = v / size
            v = v - fixed @ (fixed.T @ v) - kept @ (kept.T @ v)
            kept = np.concatenate([kept, (v / np.linalg.norm(v))[:, None]], axis=1)
    return kept


def minres(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int) -> np.ndarray:
    """Some steps of MINRES for symmetric systems with one right side a column, all
    columns in step. A column whose Krylov space ends stays as it is."""
    x = np.zeros_like(b)
    beta = np.linalg.norm(b, axis=0)
    tiny = beta * EPS * 4
    live = beta > 0
    older, old, left = np.zeros_like(b), b.copy(), beta.copy()
    beta_before = np.ones_like(beta)
    w, w_before = np.zeros_like(b), np.zeros_like(b)
    cos, sin, bar, eps = -np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    for step in range(steps):
        if not live.any():
            break
        v = np.where(live, old / np.where(live, beta, 1), 0)
        y = apply(v)
        if step:
            y = y - older * np.where(live, beta / beta_before, 0)
        alpha = (v * y).sum(axis=0)
        y = y - old * np.where(live, alpha / np.where(live, beta, 1), 0)
        older, old = old, y
        beta_before, beta = np.where(live, beta, 1), np.linalg.norm(y, axis=0)
        # The next column of the tridiagonal matrix under the rotations so far, then one more rotation.
        eps_before, delta = eps, cos * bar + sin * alpha
        bar_now = sin * bar - cos * alpha
        eps, bar = sin * beta, -cos * beta
        gamma = np.maximum(np.hypot(bar_now, beta), np.finfo(np.float64).tiny)
        cos, sin = bar_now / gamma, beta / gamma
        w, w_before = (v - eps_before * w_before - delta * w) / gamma, w
        x = x + np.where(live, cos * left * w, 0)
        left = sin * left
        live = live & (beta > tiny)
    return x


def eigenpairs(product: Callable[[np.ndarray], np.ndarray], dim: int, k: int, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest eigenvalues in falling order, unit eigenvectors and residuals of
    a symmetric positive semidefinite operator that is known by its products alone."""
    k = min(k, dim)
    first = min(dim, k + GUARD)
    basis = orthonormal(np.random.default_rng(7).standard_normal((dim, first)))
    image = product(basis)
    locked, images = np.zeros((dim, 0)), np.zeros((dim, 0))
    before = np.full(k, np.inf)
    for _ in range(ROUNDS):
        small = basis.T @ image
        value, turn = np.linalg.eigh((small + small.T) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        want = k - locked.shape[1]
        u, theta = basis[:, :want], value[:want]
        rest = image[:, :want] - u * theta
        rest = rest - locked @ (locked.T @ rest)
        size = np.linalg.norm(rest, axis=0)
        scale = max(value.max(initial=0.0), np.linalg.norm(images, axis=0).max(initial=0.0))
        full = locked.shape[1] + basis.shape[1] >= dim
        # Double precision: at rounding level, or near it and no longer falling.
        done = (size <= 4 * EPS * np.sqrt(dim) * scale) | ((size <= 1e-11 * scale) & ((size > before[-want:] / 2) | full))
        before = size
        n = want if done.all() else int(np.argmin(done))
        locked, images = np.concatenate([locked, u[:, :n]], axis=1), np.concatenate([images, image[:, :n]], axis=1)
        basis, image, before = basis[:, n:], image[:, n:], before[n:]
        u, theta, rest = u[:, n:], theta[n:], rest[:, n:]
        if locked.shape[1] == k:
            break
        if full:
            raise ArithmeticError("the residuals of the whole space are above rounding")
        if basis.shape[1] > 3 * first:
            basis, image = basis[:, :2 * first], image[:, :2 * first]
        fixed = np.concatenate([locked, u], axis=1)
        away = lambda y: y - fixed @ (fixed.T @ y)
        t = minres(lambda y: away(product(y) - y * theta), -away(rest), steps)
        new = orthonormal(t, locked, basis)
        if not new.shape[1]:  # corrections within the space: widen it by anything else
            new = orthonormal(np.random.default_rng(basis.shape[1]).standard_normal((dim, min(first, dim - locked.shape[1] - basis.shape[1]))), locked, basis)
        basis, image = np.concatenate([basis, new], axis=1), np.concatenate([image, product(new)], axis=1)
    else:
        raise ArithmeticError(f"{k - locked.shape[1]} of {k} eigenpairs did not converge")
    # Rayleigh-Ritz once more on the locked vectors with fresh products.
    locked = np.linalg.qr(locked)[0]
    images = product(locked)
    small = locked.T @ images
    value, turn = np.linalg.eigh((small + small.T) / 2)
    value, turn = value[::-1], turn[:, ::-1]
    vectors = locked @ turn
    return value, vectors, np.linalg.norm(images @ turn - vectors * value, axis=0)


# --------------------------------------------------------------- whitening

def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """One row a vector and component: the key, component, n, deviation, whitened, explained, identity_error."""
    named = table.schema[key].dataType
    vectors = whole_vectors(table, key, vector)
    common = vectors.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    dim = common["dim"] if common else 0
    schema = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    nothing = vectors.select(F.col("key").alias(key)).where("false").selectExpr(
        f"`{key}`", *[f"cast(null as {t}) as {c}" for c, t in (x.split() for x in schema.split(", "))])
    if not dim:
        return nothing
    vectors = vectors.where(F.size("x") == dim)
    fit = FitList(vectors, dim)
    value, axes, _ = eigenpairs(fit.product, dim, components)
    real = value > 64 * EPS * dim * max(value.max(initial=0.0), 0.0)
    if fit.n < 2 or not real.any():
        return nothing
    value, axes = value[real], axes[:, real]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    weights = axes / np.sqrt(value)
    error, trace = fit.identity_error(weights), fit.trace()
    n, whole, centred, k = fit.n, fit.whole, fit.centred(), len(value)
    rest = np.array([r for r in fit.rest], np.int64)  # below n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), dim)
            for i in range(0, len(x), step := max(1, BLOCK // (8 * dim))):
                part = x[i: i + step]
                # Exact modulo 2^64; the double tells whether the sum is a long.
                with np.errstate(over="ignore"):
                    off = (part - whole) * np.int64(n) - rest
                    deviation = (off * off).sum(axis=1)
                fits = ((((part - whole).astype(np.float64) * n - rest) ** 2).sum(axis=1)) < 9.2e18
                z = centred(part) @ weights
                rows = np.repeat(np.arange(i, i + len(part)), k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))),
                     pa.array(np.repeat(deviation, k), mask=np.repeat(~fits, k)), pa.array(z.ravel())],
                    names=["key", "component", "deviation", "whitened"])

    out = vectors.mapInArrow(run, f"key {named.simpleString()}, component int, deviation long, whitened double")
    shares = F.array(*[F.lit(float(v / trace)) for v in value])
    return out.select(F.col("key").alias(key), "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                      F.element_at(shares, F.col("component")).alias("explained"), F.lit(error).alias("identity_error"))
