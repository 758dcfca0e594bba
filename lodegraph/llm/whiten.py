"""Whitening of embeddings: streaming moments, a symmetric QR eigen-solve, projection.

Every task streams over its rows and keeps a count, exact sums and the matrix of centred products. A new
row ``x`` that meets ``k`` rows of mean ``m`` adds ``k / (k + 1) * (x - m)(x - m)'`` (Welford's rank-one
update); the updates of an Arrow batch are laid side by side and added by one matrix product, with means
from exact running sums. Parts of tasks are merged by the parallel formula, some at a time in tasks, the
last few by the driver, which then reduces the covariance to three diagonals and turns those into
eigenvalues by implicitly shifted QR steps. Nothing that grows with the rows leaves the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm.runtime import Scratch, table

#: Steps to a unit, and what is added so that grid values are seldom negative (fixed values of the contract).
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Parts of moments that one task merges, and rows that are taken up together.
FAN_IN, BLOCK = 32, 4096
#: A component counts if its eigenvalue is at least this share of the largest one; below it double precision knows no direction.
RANK_SHARE = 1e-12
#: Beyond this an entry times ``SCALE`` is no whole number of a long.
LARGEST = float(1 << 55)


@dataclass
class Moments:
    """Count, exact sums and centred products of some rows of whole numbers."""

    n: int
    sums: np.ndarray
    products: np.ndarray

    @classmethod
    def of(cls, dim: int) -> Moments:
        return cls(0, np.zeros(dim, dtype=object), np.zeros((dim, dim)))

    def take(self, x: np.ndarray) -> None:
        """Welford's update for each row of ``x`` (longs), one after the other."""
        for lo in range(0, len(x), BLOCK):
            rows = x[lo : lo + BLOCK]
            k = self.n + np.arange(len(rows))
            before = np.concatenate([np.zeros((1, rows.shape[1]), dtype=np.int64), np.cumsum(rows - SHIFT, axis=0)[:-1]])
            base = (self.sums - self.n * SHIFT).astype(np.float64)
            mean = (base + before) / np.maximum(k, 1)[:, None]
            away = (rows - SHIFT) - mean
            self.products += (away * (k / (k + 1))[:, None]).T @ away
            self.sums = self.sums + rows.sum(axis=0).astype(object)
            self.n += len(rows)

    def merge(self, other: Moments) -> None:
        """The parallel formula: products about the common mean."""
        if other.n:
            n = self.n + other.n
            if self.n:
                apart = (self.n * other.sums - other.n * self.sums) / (self.n * other.n)
                apart = apart.astype(np.float64)
                self.products += np.outer(apart, apart) * (self.n / n * other.n)
            self.products += other.products
            self.sums, self.n = self.sums + other.sums, n

    def covariance(self) -> np.ndarray:
        return (self.products + self.products.T) / (2 * self.n)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder reduction of a symmetric matrix: diagonal, side diagonal, and the orthogonal ``q`` with ``a = q t q'``."""
    a, n = a.astype(np.float64).copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.sqrt(v @ v)
        if size == 0 or not v[1:].any():
            continue
        v[0] += size if v[0] >= 0 else -size
        v /= np.sqrt(v @ v)
        p = a[k + 1 :, k + 1 :] @ v
        w = 2 * (p - (v @ p) * v)
        a[k + 1 :, k + 1 :] -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def symmetric_eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and unit eigenvectors as columns, by implicit QR steps with Wilkinson's shift.

    An eigenvector's largest entry (the first of equals) is positive.
    """
    d, e, q = tridiagonal(np.asarray(a, dtype=np.float64))
    turned = np.ascontiguousarray(q.T)  # a row a vector: rotations mix two of them
    hi, eps = len(d) - 1, np.finfo(np.float64).eps
    while hi > 0:
        small = eps * (np.abs(d[:-1]) + np.abs(d[1:]))
        e[np.abs(e) <= small] = 0.0
        if e[hi - 1] == 0:
            hi -= 1
            continue
        lo = hi - 1
        while lo > 0 and e[lo - 1] != 0:
            lo -= 1
        half = (d[hi - 1] - d[hi]) / 2
        side = e[hi - 1]
        root = np.hypot(half, side)
        shift = d[hi] - side * side / (half + (root if half >= 0 else -root))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            one, two, off = d[k], d[k + 1], e[k]
            d[k] = c * c * one + 2 * c * s * off + s * s * two
            d[k + 1] = s * s * one - 2 * c * s * off + c * c * two
            e[k] = c * s * (two - one) + (c * c - s * s) * off
            if k < hi - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            turned[[k, k + 1]] = np.array([[c, s], [-s, c]]) @ turned[[k, k + 1]]
    order = np.argsort(-d, kind="stable")
    vectors = turned[order]
    top = np.abs(vectors).argmax(axis=1)
    vectors = vectors * np.where(vectors[np.arange(len(d)), top] < 0, -1.0, 1.0)[:, None]
    return d[order], vectors.T


PARTS = "part int, n long, sums array<decimal(38,0)>, products binary"


def _row(part: int, m: Moments) -> pa.RecordBatch:
    sums = pa.array([[*m.sums]], pa.list_(pa.decimal128(38, 0)))
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([m.n], pa.int64()), sums, pa.array([m.products.tobytes()], pa.binary())], names=["part", "n", "sums", "products"])


def _read(rows: list[dict], dim: int) -> Moments:
    whole = Moments.of(dim)
    for r in rows:
        whole.merge(Moments(r["n"], np.array([int(x) for x in r["sums"]], dtype=object), np.frombuffer(bytes(r["products"]), dtype=np.float64).reshape(dim, dim).copy()))
    return whole


def moments(grid: DataFrame, dim: int) -> Moments | None:
    """Moments of a table of whole-number vectors ``x``; nothing for no rows."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = Moments.of(dim)
        for b in batches:
            x = _matrix(b["x"])
            if len(x):
                own.take(x)
        if own.n:
            yield _row(TaskContext.get().partitionId(), own)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["part"])
        if rows:
            yield _row(rows[0]["part"], _read(rows, dim))

    parts, left = grid.mapInArrow(stream, PARTS), grid.rdd.getNumPartitions()
    while left > FAN_IN:
        left = -(-left // FAN_IN)
        parts = parts.repartition(left, F.col("part") % left).mapInArrow(gather, PARTS)
    rows = sorted((r.asDict() for r in parts.collect()), key=lambda r: r["part"])  # at most FAN_IN rows of dim * dim numbers
    return _read(rows, dim) if rows else None


def _matrix(col: pa.Array) -> np.ndarray:
    values = np.asarray(col.flatten())
    return values.reshape(len(col), -1) if len(col) else values.reshape(0, 0)


def usable(vec: str) -> str:
    """Vectors without null or non-finite entries, none so large that its grid value is no long."""
    return f"{vec} is not null and forall({vec}, x -> x is not null and not isnan(x) and abs(x) < {LARGEST:.1f}D)"


def whiten(rows: DataFrame, scratch: Scratch, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each row and component.

    Entries are laid on a grid (``floor(64 * c) + 1000000``); each distinct grid vector counts once in the fit, however often it
    occurs. ``n`` is their number, ``deviation`` a row's exact sum of ``(n * x - sum)^2`` (null where that is beyond a long),
    ``whitened`` the row's offset from the mean along the component over the root of its eigenvalue. Components are numbered by
    falling eigenvalue, up to ``components`` of them, and only those whose eigenvalue is above rounding (1e-12 of the largest):
    one distinct vector has none, so such a table gives no rows. ``identity_error`` is the largest deviation from the identity of
    the covariance of the whitened fit rows, measured on them.

    Rows with a null vector, one with null, non-finite or huge (2^55 and more) entries, an empty one, or one of another length than most (of equally
    frequent lengths the smaller counts) are dropped. Repeated rows and null ids are kept as they are, ties in eigenvalue stay in the solver's order,
    an empty table gives no rows, other columns are not read.
    """
    spark = rows.sparkSession
    kind = rows.schema[id_col].dataType.simpleString()
    result = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = rows.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where(usable("v")).where("size(v) > 0")
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], result)
    dim = lengths["d"]
    rows = rows.where(F.size("v") == dim).select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))
    fit = scratch.write(rows.select("x").distinct(), "fit")
    found = moments(fit, dim)
    covariance = found.covariance()
    values, vectors = symmetric_eigen(covariance)
    used = int((values > max(values[0], 0) * RANK_SHARE).sum()) if values[0] > 0 else 0
    used = min(used, components)
    if not used:
        return spark.createDataFrame([], result)
    project = vectors[:, :used] / np.sqrt(values[:used])
    share = values[:used] / np.trace(covariance)
    error = _identity_error(fit, project, found, used)
    n, sums = found.n, found.sums
    # A row's deviation, and the products in it, are exact in longs if the largest possible ones are.
    low, high = (int(v) for v in fit.select(F.min(F.array_min("x")), F.max(F.array_max("x"))).first())
    span = max(abs(n * b - s) for b in (low, high) for s in sums)
    held = spark.sparkContext.broadcast((project, sums, n, share))
    wide = span * span * dim >= 1 << 63

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, sums, n, share = held.value
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                b = batch.slice(lo, BLOCK)
                x = _matrix(b["x"])
                if wide:
                    offset = x.astype(object) * n - sums
                    far = (offset * offset).sum(axis=1)
                    far = pa.array([int(f) if f < 1 << 63 else None for f in far], pa.int64())
                    offset = offset.astype(np.float64)
                else:
                    offset = x * n - sums.astype(np.int64)
                    far = pa.array((offset * offset).sum(axis=1), pa.int64())
                whitened = (offset / n) @ project
                each = np.repeat(np.arange(len(x)), used)
                yield pa.RecordBatch.from_arrays(
                    [b["vec_id"].take(pa.array(each)), pa.array(np.tile(np.arange(1, used + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), n, dtype=np.int64)), far.take(pa.array(each)), pa.array(whitened.ravel()), pa.array(np.tile(share, len(x))), pa.array(np.full(len(each), error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(place, result)


def _identity_error(fit: DataFrame, project: np.ndarray, found: Moments, used: int) -> float:
    """Largest entry of the whitened fit rows' covariance minus the identity, from their own products."""
    n, sums = found.n, found.sums
    held = fit.sparkSession.sparkContext.broadcast((project, sums, n))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, sums, n = held.value
        total, first = np.zeros((used, used)), np.zeros(used)
        mean = np.array([float(s - n * SHIFT) for s in sums]) / n
        for b in batches:
            x = _matrix(b["x"])
            for lo in range(0, len(x), BLOCK):
                w = (x[lo : lo + BLOCK] - SHIFT - mean) @ project
                total += w.T @ w
                first += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(used * used + used, dtype=np.int32)), pa.array(np.concatenate([total.ravel(), first]))], names=["at", "value"])

    # One sum an entry: at most 16 * 17 rows.
    rows = fit.mapInArrow(stream, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    flat = np.zeros(used * used + used)
    flat[[r["at"] for r in rows]] = [r["value"] for r in rows]
    mean = flat[used * used :] / n
    return float(np.abs(flat[: used * used].reshape(used, used) / n - np.outer(mean, mean) - np.eye(used)).max())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: up to 16 whitened components of every embedding."""
    return whiten(table(spark, sf_dir, "embeddings"), Scratch(spark, "op13"))
