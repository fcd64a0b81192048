"""Whitening components of embedding vectors by shifted CholeskyQR.

The centred rows X are a tall matrix that never leaves its tasks. A pass sums the Gram matrix of the rows over all tasks;
its Cholesky factor R then orthogonalises the rows by triangular solves, and the next pass takes the Gram matrix of those.
The first factor is shifted so that it exists whatever the condition of X; later passes repair the loss. The composed
factor R = Rk .. R2 R1 holds X = Q R with orthonormal Q, so the singular values and right vectors of the small R are those
of X. The driver and the tasks hold matrices of the vector length squared, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirspan.llm.common import stored

#: Entries become ``floor(SCALE * c) + OFFSET``; beyond +-``LARGEST`` they are clipped.
SCALE = 1024
OFFSET = 100_000
LARGEST = 1 << 40
COMPONENTS = 8
#: Passes end once what is left to orthogonalise is this small against the largest eigenvalue.
TOLERANCE = 1e-15
MOST_PASSES = 12
#: Components below this share of the largest eigenvalue are rounding noise and are left out.
SMALLEST = 1e-12

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def fixed_points(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``vec_id, x`` (array<long>) of the rows that take part: no NULL, NaN or infinite entry, and the most frequent length."""
    rows = vectors.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.col(f"`{vector_column}`").cast("array<double>").alias("v")).where("size(v) > 0")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where(~F.coalesce(bad, F.lit(True)))

    def point(c):
        return F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), c * SCALE))) + OFFSET

    rows = stored(rows.select("vec_id", F.transform("v", point).alias("x")))
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("x") == (sizes[0]["d"] if sizes else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a batch, all of one length, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def solve_rows(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Q with ``Q @ r = rows`` for an upper triangle ``r``, column by column."""
    q = np.empty_like(rows)
    for j in range(r.shape[0]):
        q[:, j] = (rows[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def _sums(points: DataFrame, of=None) -> tuple[int, np.ndarray]:
    """Number of rows and the sum of each dimension; exact for the points themselves."""
    kind = np.int64 if of is None else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                n, total = n + len(x), total + (x if of is None else of(x)).sum(0, dtype=kind)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array(total)], names=["i", "n", "total"])

    parts = points.select("x").mapInArrow(run, f"i int, n long, total {'long' if of is None else 'double'}")
    found = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("i").collect()
    return (found[0]["n"] if found else 0), np.array([r["total"] for r in found], kind)


def _gram(points: DataFrame, of) -> np.ndarray:
    """Sum of the outer products of the rows ``of(x)``, one matrix a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                q = of(_matrix(batch.column(0)))
                total = q.T @ q if total is None else total + q.T @ q
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "row"])

    cells = points.select("x").mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "value"))
    found = cells.groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    size = 1 + max(r["i"] for r in found)
    gram = np.zeros((size, size))
    for r in found:
        gram[r["i"], r["j"]] = r["value"]
    return gram


def _factor(gram: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """Upper Cholesky factor; shifted if asked, or if rounding keeps the plain one from existing."""
    if not shifted:
        try:
            return np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            pass
    d = len(gram)
    shift = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * np.trace(gram)
    return np.linalg.cholesky(gram + shift * np.eye(d)).T


def triangle(points: DataFrame, n: int, mean: np.ndarray) -> np.ndarray:
    """R of X = Q R for the centred points."""
    factors: list[np.ndarray] = []

    def rows(x: np.ndarray) -> np.ndarray:
        q = x - mean
        for r in factors:
            q = solve_rows(q, r)
        return q

    composed = np.eye(len(mean))
    for k in range(MOST_PASSES):
        gram = _gram(points, rows)
        if not gram.any():
            return gram  # all points are equal
        left = composed.T @ (gram - np.eye(len(gram))) @ composed
        if k and np.abs(left).max() <= TOLERANCE * (composed**2).sum():
            break
        factor = _factor(gram, n, shifted=k == 0)
        factors.append(factor)
        composed = factor @ composed
    return composed


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every vector and leading component.

    Rows whose vector is NULL, empty or holds NULL, NaN or infinite entries take no part, nor do vectors of another length
    than the most frequent one (the longest of several). A NULL or repeated id is a row like any other. Components are
    numbered by falling eigenvalue; those without variance are left out, so equal or constant vectors give fewer rows or
    none, as an empty table does. Equal eigenvalues share a space in which any basis may come. ``deviation`` is exact, and
    NULL where a long cannot hold it. Other columns are ignored.
    """
    points = fixed_points(vectors, id_column, vector_column)
    n, total = _sums(points)
    if not n:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    mean = total / n
    _, sigma, right = np.linalg.svd(triangle(points, n, mean))
    value = sigma**2 / n
    kept = [k for k in range(min(components, len(value))) if value[k] > SMALLEST * value[0]]
    if not kept:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    turn = right[kept].T / np.sqrt(value[kept])
    explained = value[kept] / value.sum()

    def white(x: np.ndarray) -> np.ndarray:
        return (x - mean) @ turn

    middle = _sums(points, white)[1] / n
    error = float(np.abs(_gram(points, lambda x: white(x) - middle) / n - np.eye(len(kept))).max())

    def deviations(x: np.ndarray) -> list[int | None]:
        off = n * x - total
        if not len(off) or float(np.abs(off).max()) ** 2 * off.shape[1] < 2**62:
            return (off**2).sum(1).tolist()
        exact = [sum(v * v for v in row) for row in off.tolist()]
        return [v if v < 2**63 else None for v in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, k = _matrix(batch.column(1)), len(kept)
            rows = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, n)),
                    pa.array(deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(white(x).ravel()),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return points.select("vec_id", "x").mapInArrow(run, SCHEMA)
