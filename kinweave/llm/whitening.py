"""PCA whitening of embeddings (operator 13).

The scatter of the centred, distinct vectors is added up by Spark.  What
reaches the driver is that one matrix of d x d sums, d being the length of a
vector.  There it goes through a Cholesky factorisation with diagonal pivoting,
which stops at its rank, and one-sided Jacobi rotations of the factor's columns:
once these are orthogonal to each other, their squared norms are the
eigenvalues of the scatter and the columns over their norms its eigenvectors.
The scatter itself is never rotated, so small eigenvalues keep their digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.rows import quoted
from kinweave.plans.lineage import cut
from kinweave.plans.tables import table

#: Whole numbers per unit of an entry.
SCALE = 256
#: Entries from here on are no embedding; sums of those below fit a long for four thousand million vectors.
LARGEST = 1 << 22
#: The longest vectors: a matrix of doubles of 128 MB on the driver.
MOST_DIMENSIONS = 4096
#: Numbers of a batch that are worked on at once.
STEP = 1 << 20
#: Columns of a task's matrix that are one row of what it tells.
BLOCK = 64


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L of d rows and as many columns as ``a`` has rank, with L @ L.T == a; the largest diagonal entry left is the next pivot."""
    a = np.array(a, np.float64)
    d = len(a)
    out = np.zeros((d, d))
    left = a.diagonal().copy()
    least = (left.max() if d else 0.0) * d * np.finfo(float).eps
    for k in range(d):
        p = int(left.argmax())
        if left[p] <= least:
            return out[:, :k]
        column = (a[:, p] - out[:, :k] @ out[p, :k]) / np.sqrt(left[p])
        column[left == 0] = 0  # rows that were pivots
        out[:, k] = column
        left = np.maximum(left - column**2, 0)
        left[p] = 0
    return out


def _meetings(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rounds of disjoint pairs of 0 .. n-1 in which every pair meets once; n is even."""
    ring = np.arange(n)
    for _ in range(n - 1):
        yield ring[: n // 2], ring[: n // 2 - 1 : -1]
        ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of factor @ factor.T.

    Pairs of columns are rotated until all are orthogonal to working precision;
    the disjoint pairs of a round are rotated together.
    """
    d, r = factor.shape
    g = np.zeros((d, r + r % 2))
    g[:, :r] = factor
    for _ in range(sweeps if r > 1 else 0):
        most = 0.0
        for i, j in _meetings(g.shape[1]):
            x, y = g[:, i], g[:, j]
            a, b, c = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(a * b)
            off = np.abs(c) > np.finfo(float).eps * size
            if not off.any():
                continue
            most = max(most, float((np.abs(c[off]) / size[off]).max()))
            zeta = (b - a)[off] / (2 * c[off])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            cos = 1 / np.hypot(1, t)
            i, j, x, y = i[off], j[off], x[:, off], y[:, off]
            g[:, i], g[:, j] = cos * x - cos * t * y, cos * t * x + cos * y
        if most <= d * np.finfo(float).eps:
            break
    norms = np.sqrt((g * g).sum(0))
    order = np.argsort(-norms, kind="stable")[:r]
    return norms[order] ** 2, g[:, order] / np.where(norms[order] > 0, norms[order], 1)


def principal_components(scatter: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(variances falling, components as columns) of the covariance scatter / n; of each component the entry of largest size is positive."""
    values, vectors = one_sided_jacobi(pivoted_cholesky(scatter / n))
    if vectors.size:
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    return values, vectors


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """The vector as whole numbers floor(scale * entry); null if it is null, empty, or holds a null, NaN, infinity or entry of LARGEST or more."""
    number = lambda c: c.cast("double")
    fine = F.forall(vector, lambda c: F.coalesce(F.abs(number(c)) < F.lit(float(LARGEST)), F.lit(False)))
    return F.when(fine & (F.size(vector) > 0), F.transform(vector, lambda c: F.floor(number(c) * scale).cast("long")))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """The whole-number vectors of a batch's column as rows."""
    return column.flatten().to_numpy().reshape(-1, d)


def _pieces(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    step = max(1, STEP // d)
    for batch in batches:
        for k in range(0, batch.num_rows, step):
            yield batch.slice(k, step)


def _sums(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sums of (i, block, values) over all tasks, as a matrix."""
    added = parts.groupBy("i", "block").agg(*(F.sum(F.get("values", F.lit(j))).alias(f"v{j}") for j in range(BLOCK))).toArrow()
    out = None
    for j in range(BLOCK):
        values = added.column(f"v{j}").fill_null(0).to_numpy()
        if out is None:
            out = np.zeros((shape[0], -(-shape[1] // BLOCK), BLOCK), values.dtype)
        out[added.column("i").to_numpy(), added.column("block").to_numpy(), j] = values
    return out.reshape(shape[0], -1)[:, : shape[1]]


def _task_sums(rows: DataFrame, d: int, kind: str, of, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all vectors of the matrix that ``of`` gives for some (whole numbers, as rows); each task tells one matrix, in blocks of columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in _pieces(batches, d):
            one = of(_matrix(batch.column(0), d))
            total = one if total is None else total + one
        if total is not None:
            for k in range(0, shape[1], BLOCK):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(shape[0], dtype=np.int32)), pa.array(np.full(shape[0], k // BLOCK, np.int32)), pa.array(list(total[:, k : k + BLOCK]))], ["i", "block", "values"])

    return _sums(rows.select("x").mapInArrow(run, f"i int, block int, values array<{kind}>"), shape)


def whitened(vectors: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per usable vector and component, components from 1.

    The model is fitted on the distinct vectors, each once, however often it
    occurs: ``n`` of them, as whole numbers floor(scale * entry), with sums S per
    dimension.  ``deviation`` is the sum of (n * x - S) ** 2 (decimal, exact;
    null where it has over 38 digits), ``whitened`` the centred vector projected on the component
    over the root of its variance, ``explained`` the component's share of all
    variance, ``identity_error`` the largest entry of the whitened covariance
    minus the identity.

    Vectors that are null, empty, or hold null, NaN, infinite or entries of 2 ** 22 or more
    are left out, as are those whose length is not the commonest (of
    several the longest).  Repeated rows and null ids are kept.  A component
    without variance can't be scaled, so there are as many as the fit list
    has rank; of equal vectors alone, or of none, nothing is returned.  Other
    columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(quoted(id_col).alias("vec_id"), quantised(quoted(vector_col), scale).alias("x")).filter("x is not null")
    nothing = spark.createDataFrame([], f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return nothing
    d = lengths["d"]
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {d} entries: a matrix of {d} x {d} is more than the driver is meant to hold")
    rows = rows.filter(F.size("x") == d)
    fit = cut(rows.select("x").distinct())

    first = lambda x: np.concatenate([x.sum(0), [len(x)]])[None]
    total = _task_sums(fit, d, "long", first, (1, d + 1))[0]
    sums, n = total[:d], int(total[d])
    mean = sums / n
    centred = lambda x: x - mean

    def scatter(x: np.ndarray) -> np.ndarray:
        z = centred(x)
        return z.T @ z

    values, vectors_of = principal_components(_task_sums(fit, d, "double", scatter, (d, d)), n)
    k = min(components, len(values))
    if not k:
        return nothing
    scaled = vectors_of[:, :k] / np.sqrt(values[:k])

    # The covariance of what comes out, from the data again: first its mean (zero but for rounding), then the centred products.
    drift = _task_sums(fit, d, "double", lambda x: (centred(x) @ scaled).sum(0)[None], (1, k))[0] / n

    def products(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ scaled - drift
        return w.T @ w

    error = float(np.abs(_task_sums(fit, d, "double", products, (k, k)) / n - np.eye(k)).max())
    explained = values[:k] / values.sum()
    exact = [int(s) for s in sums]
    names, schema = nothing.columns, nothing.schema

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, d):
            x = _matrix(batch.column(1), d)
            m = len(x)
            w = centred(x) @ scaled
            far = int(np.abs(x).max()) * n + max(map(abs, exact))
            if far * far * d < 1 << 63:
                deviation = ((x * n - sums) ** 2).sum(1).tolist()
            else:  # whole numbers of any size
                deviation = ((x.astype(object) * n - np.array(exact, object)) ** 2).sum(1).tolist()
            deviation = [v if v < 10**38 else None for v in deviation]
            take = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(take), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                pa.array(deviation, pa.decimal128(38, 0)).take(take), pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))], names)

    return rows.mapInArrow(project, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` as a long; null where it does not fit one."""
    return whitened(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))
