"""Embedding whitening: principal components of the distinct vectors, and every vector projected on them.

Spark sums the centred products of blocks of vectors; the covariance that results has as many rows
as a vector has dimensions, whatever the number of vectors. Its leading eigenpairs come from
Householder tridiagonalisation, bisection by Sturm counts and inverse iteration, and the projection
on them is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, spread, stored
from .learning import shared

_EPS = np.finfo(np.float64).eps


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and the orthogonal Q with a = Q T Q', by Householder reflections."""
    a, d = np.array(a, dtype=np.float64), len(a)
    q = np.eye(d)
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(x)
        if size == 0:
            continue
        u = x / size
        a[k + 1 :, :] -= 2 * np.outer(u, u @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ u, u)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ u, u)
    return np.diag(a).copy(), (np.diag(a, 1) + np.diag(a, -1)) / 2, q


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each of ``at``."""
    least = _EPS * max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0), 1e-300)
    counts, pivot = np.zeros(len(at), dtype=np.int64), np.ones(len(at))
    for i, x in enumerate(diagonal):
        pivot = x - at - (off[i - 1] ** 2 / pivot if i else 0.0)
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        counts += pivot < 0
    return counts


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, bisected until an interval has no double inside it."""
    d = len(diagonal)
    beside = np.zeros(d)
    beside[1:] += np.abs(off)
    beside[:-1] += np.abs(off)
    low, high = np.full(k, (diagonal - beside).min()), np.full(k, (diagonal + beside).max())
    rank = d - np.arange(k)  # the j-th largest has d - j eigenvalues at most below any point under it
    high += _EPS * np.abs(high) + 1e-300
    for _ in range(1100):
        middle = low + (high - low) / 2
        if not ((middle > low) & (middle < high)).any():
            break
        below = sturm_counts(diagonal, off, middle) >= rank
        high, low = np.where(below, middle, high), np.where(below, low, middle)
    return low


def _solved(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, least: float) -> np.ndarray:
    """(T - shift I) z = b by elimination with row exchanges; vanishing pivots become ``least``."""
    d = len(diagonal)
    main, up, up2, z = diagonal - shift, np.append(off, 0.0), np.zeros(d), b.copy()
    low = off.copy()
    for i in range(d - 1):
        if abs(low[i]) > abs(main[i]):
            main[i], low[i] = low[i], main[i]
            up[i], main[i + 1] = main[i + 1], up[i]
            if i + 2 < d:
                up2[i], up[i + 1] = up[i + 1], 0.0
            z[i], z[i + 1] = z[i + 1], z[i]
        pivot = main[i] if abs(main[i]) > least else least
        main[i], ratio = pivot, low[i] / pivot
        main[i + 1] -= ratio * up[i]
        if i + 2 < d:
            up[i + 1] -= ratio * up2[i]
        z[i + 1] -= ratio * z[i]
    for i in range(d - 1, -1, -1):
        pivot = main[i] if abs(main[i]) > least else least
        z[i] = (z[i] - (up[i] * z[i + 1] if i + 1 < d else 0.0) - (up2[i] * z[i + 2] if i + 2 < d else 0.0)) / pivot
    return z


def leading_pairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of the ``k`` leading pairs of a symmetric matrix.

    Inverse iteration starts from fixed random vectors; within a cluster (values closer than a
    thousandth of the largest) each vector is kept orthogonal to those before it.
    """
    d = len(matrix)
    k = min(k, d)
    diagonal, off, q = tridiagonal(matrix)
    values = leading_values(diagonal, off, k)
    size = max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0))
    if size == 0:
        return np.zeros(k), np.eye(d)[:, :k]
    rng, found, first = np.random.default_rng(1), np.zeros((d, k)), 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * size:
            first = j
        shift = value - (j - first) * 4 * _EPS * size  # equal values get shifts that differ
        z = rng.standard_normal(d)
        for _ in range(6):
            z = _solved(diagonal, off, shift, z / np.linalg.norm(z), _EPS * size)
            z /= np.abs(z).max()
            for _ in range(2):
                z -= found[:, first:j] @ (found[:, first:j].T @ z)
        found[:, j] = z / np.linalg.norm(z)
    return values, q @ found


def _block(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _summed(parts: DataFrame, at: list[str]) -> list:
    """Sums of the tasks' arrays ``v``, place by place; as many rows as an array has places."""
    return parts.select(*at, F.posexplode("v").alias("j", "v")).groupBy(*at, "j").agg(F.sum("v").alias("v")).collect()


def whiten(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shift: int = 1_000_000, components: int = 16, least_share: float = 1e-12
) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)``: a row for each vector and component.

    Components c of a vector become x = floor(scale * c) + shift. Means and covariance (divisor n)
    are those of the n distinct x; they are centred, exactly, before they are multiplied.
    ``deviation`` is the sum over dimensions of (n x - S)^2 with S the sums of the distinct x,
    ``whitened`` the projection on the unit eigenvector over the root of its eigenvalue,
    ``explained`` the eigenvalue's share of the trace, and ``identity_error`` the largest absolute
    entry of (covariance of the whitened distinct vectors - identity).

    Null vectors, vectors with null or non-finite entries, and vectors of another length than most
    (ties: the longer) take no part. Null ids and repeated ids are rows like others; repeated
    vectors count once in the fit. Directions with less than ``least_share`` of the largest
    eigenvalue can't be whitened and are left out; so a table with one distinct vector, or with
    none, gives no rows. Entries of 2^46 and more, and deviations beyond 64 bits, raise an error
    instead of wrapping. Memory of a task: a batch and a square of the dimensions.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    empty = spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    rows = spread(vectors).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where("v is not null and forall(v, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), F.desc("d")).first()
    if lengths is None or lengths.d == 0:
        return empty
    d = lengths.d
    held = lambda c: F.when(F.abs(c) < 2.0**46, F.floor(c * scale) + shift).otherwise(F.raise_error(F.lit("an entry of a vector is too large to be whitened")).cast("long"))
    rows = rows.where(F.size("v") == d).select("id", F.transform("v", held).alias("x"))
    distinct = stored(rows.select("x").distinct(), "distinct")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d + 1, dtype=np.int64)
        for batch in batches:
            total[:d] += _block(batch).sum(axis=0)
            total[d] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], names=["v"])

    found = {r.j: r.v for r in _summed(map_arrow(distinct, sums, "v array<bigint>"), [])}
    n, total = found[d], np.array([found[j] for j in range(d)], dtype=np.int64)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square = np.zeros((d, d))
        for batch in batches:
            centred = (n * _block(batch) - total) / n
            square += centred.T @ centred
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(square.tolist(), pa.list_(pa.float64()))], names=["i", "v"])

    covariance = np.zeros((d, d))
    for r in _summed(map_arrow(distinct, products, "i int, v array<double>"), ["i"]):
        covariance[r.i, r.j] = r.v / n
    values, directions = leading_pairs((covariance + covariance.T) / 2, components)
    values = values[values > least_share * values[0]] if values[0] > 0 else values[:0]
    k = len(values)
    if not k:
        return empty
    fitted = shared(spark, directions[:, :k] / np.sqrt(values))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square = np.zeros((k + 1, k + 1))  # the last row and column: sums
        for batch in batches:
            y = ((n * _block(batch) - total) / n) @ fitted.value
            y = np.column_stack([y, np.ones(len(y))])
            square += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(k + 1), pa.int32()), pa.array(square.tolist(), pa.list_(pa.float64()))], names=["i", "v"])

    square = np.zeros((k + 1, k + 1))
    for r in _summed(map_arrow(distinct, check, "i int, v array<double>"), ["i"]):
        square[r.i, r.j] = r.v / n
    error = float(np.abs(square[:k, :k] - np.outer(square[:k, k], square[k, :k]) - np.eye(k)).max())
    explained = (values / np.trace(covariance)).tolist()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off = n * _block(batch) - total
            if np.abs(off).max() < np.sqrt(2.0**62 / d):
                deviation = (off * off).sum(axis=1)
            else:
                deviation = pa.array([sum(v * v for v in row) for row in off.tolist()], pa.int64())  # raises beyond 64 bits
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                    pa.array(np.repeat(np.asarray(deviation), k)), pa.array(((off / n) @ fitted.value).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return map_arrow(rows, project, schema).withColumnRenamed("id", id_col)
