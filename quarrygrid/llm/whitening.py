"""Whitening of embeddings by a pivoted Cholesky factor and one-sided Jacobi rotations.

Vectors become integers, x = floor(64 c) + 1000000, each distinct vector counts once. Spark adds up the sums and then the centred scatter
of the distinct vectors, a partial matrix for each task and its sum row by row; only matrices of the dimension reach the driver.
There the scatter is factored with pivoting, and rotations of pairs of columns make the columns of the triangular factor
orthogonal: their squared norms are the eigenvalues, the normalised columns the components. The covariance itself is never
diagonalised, which keeps small eigenvalues accurate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygrid.common import bound_batches, drop_scratch, materialize, table

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Eigenvalues below this share of the largest are rounding, and their components are none.
LEAST_SHARE = 1e-12
#: Largest absolute value of an entry's integer, so that sums stay exact.
LARGEST = 1 << 40


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array<long>) of the rows that count.

    Dropped are vectors that are null, empty, or hold null, NaN or infinite entries, and those of another dimension than most have
    (of equally frequent dimensions the smaller). An integer is held to plus or minus ``LARGEST``.
    """
    entry = lambda e: e.cast("double")
    good = (F.size("embedding") > 0) & ~F.exists("embedding", lambda e: e.isNull() | F.isnan(entry(e)) | (F.abs(entry(e)) == float("inf")))
    rows = vectors.where(F.col("embedding").isNotNull()).where(F.coalesce(good, F.lit(False)))
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1)
    d = sizes.first()
    whole = lambda e: F.least(F.greatest(F.floor(entry(e) * SCALE).cast("double") + SHIFT, F.lit(-float(LARGEST))), F.lit(float(LARGEST))).cast("long")
    return rows.where(F.size("embedding") == (d["d"] if d else 0)).select("vec_id", F.transform("embedding", whole).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length as a table."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def summed(rows: DataFrame, partial: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``partial`` over blocks of (x): a table of so many rows and ``size`` columns; tasks add up their own, Spark adds the tasks' row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _matrix(batch.column(0))
            for lo in range(0, len(x), 4096):
                own = partial(x[lo : lo + 4096])
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total), pa.list_(pa.from_numpy_dtype(total.dtype)))], ["i", "part"])

    kind = "long" if size < 0 else "double"
    parts = rows.select("x").mapInArrow(run, f"i long, part array<{kind}>")
    cells = parts.select("i", F.posexplode("part").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow().to_pandas()
    out = np.zeros((int(cells["i"].max()) + 1 if len(cells) else 0, abs(size)), np.int64 if size < 0 else np.float64)
    out[cells["i"].to_numpy(np.int64), cells["j"].to_numpy(np.int64)] = cells["v"].to_numpy()
    return out


def pivoted_cholesky(a: np.ndarray, least: float = 1e-15) -> tuple[np.ndarray, np.ndarray]:
    """(L, order): lower triangular L with ``a[order][:, order] = L L'``, the largest remaining diagonal entry first; it has as many columns as the rank."""
    a = a.copy()
    n = len(a)
    order, factor = np.arange(n), np.zeros((n, n))
    left = np.diag(a).copy()
    stop = least * max(left.max(initial=0), 0) * n
    for k in range(n):
        p = k + int(np.argmax(left[k:]))
        if left[p] <= stop:
            return factor[:, :k], order
        for rows in (order, left, factor):
            rows[[k, p]] = rows[[p, k]]
        factor[k, k] = np.sqrt(left[k])
        column = a[order[k + 1 :], order[k]] - factor[k + 1 :, :k] @ factor[k, :k]
        factor[k + 1 :, k] = column / factor[k, k]
        left[k + 1 :] -= factor[k + 1 :, k] ** 2
    return factor, order


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``factor`` times rotations that make its columns orthogonal; a sweep meets every pair once, disjoint pairs at the same time."""
    w = factor.copy()
    r = w.shape[1]
    if r < 2:
        return w
    even = r + r % 2
    ring = np.arange(even)
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(even - 1):
            p, q = ring[: even // 2], ring[even // 2 :][::-1]
            both = (p < r) & (q < r)
            p, q = p[both], q[both]
            x, y = w[:, p], w[:, q]
            a, b, c = np.einsum("ij,ij->j", x, x), np.einsum("ij,ij->j", y, y), np.einsum("ij,ij->j", x, y)
            off = np.abs(c) / np.sqrt(a * b)
            worst = max(worst, off.max(initial=0))
            turn = off > 1e-16
            zeta = (b - a) / np.where(turn, 2 * c, 1)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta)), 0)
            cos = 1 / np.hypot(1, t)
            sin = cos * t
            w[:, p], w[:, q] = cos * x - sin * y, sin * x + cos * y
            ring = np.concatenate((ring[:1], np.roll(ring[1:], 1)))
        if worst < 1e-15:
            break
    return w


def components(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, components as columns) of a covariance; those of ``LEAST_SHARE`` or less of the largest are left out."""
    factor, order = pivoted_cholesky(covariance)
    turned = one_sided_jacobi(factor)
    value = np.einsum("ij,ij->j", turned, turned)
    pick = np.argsort(-value, kind="stable")
    pick = pick[value[pick] > LEAST_SHARE * value.max(initial=0)]
    vectors = np.zeros((len(order), len(pick)))
    vectors[order] = turned[:, pick] / np.sqrt(value[pick])
    # one sign for all rows: the entry of largest size is positive
    at = np.argmax(np.abs(vectors), axis=0) if vectors.size else np.zeros(0, int)
    return value[pick], vectors * np.where(vectors[at, np.arange(len(pick))] < 0, -1, 1)


class Whitening:
    """What the fit list gives: its size, sums, components and how near whitened vectors come to the identity."""

    def __init__(self, n: int, sums: np.ndarray, values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.sums, self.vectors, self.values, self.trace = n, sums, vectors, values, trace
        self.identity_error = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x minus the mean, to double precision: n x - S is a whole number, taken apart so that it needs no more than 64 bits."""
        whole, rest = self.sums // self.n, self.sums % self.n
        return (x - whole).astype(np.float64) - rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n x - S) squared, exact; null where it needs more than 64 bits."""
        if len(x) == 0:
            return []
        most = (max(int(np.abs(x).max()), 1) * self.n + int(np.abs(self.sums).max())) ** 2 * x.shape[1]
        if most < 1 << 63:
            return ((x * self.n - self.sums) ** 2).sum(1).tolist()
        whole, rest = self.sums // self.n, self.sums % self.n
        near = x - whole
        if (int(np.abs(near).max()) + 1) ** 2 * self.n**2 * x.shape[1] < 1 << 63:
            return ((near * self.n - rest) ** 2).sum(1).tolist()
        wide = [sum((int(v) * self.n - int(s)) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [v if v < 1 << 63 else None for v in wide]


def fit(rows: DataFrame, most: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of (x); none without rows or without variance.

    The distinct vectors are written once and read three times: for sums, for the centred scatter, and for the covariance of the result.
    """
    spark = rows.sparkSession
    distinct = materialize(rows.groupBy("x").agg(F.lit(1).alias("one")).select("x"), "whitening")
    first = distinct.first()
    if first is None:
        return None
    d = len(first["x"])
    totals = summed(distinct, lambda x: np.concatenate(([np.full(d, len(x), np.int64)], [x.sum(0)])), -d)
    n, sums = int(totals[0, 0]), totals[1]
    white = Whitening(n, sums, np.zeros(0), np.zeros((d, 0)), 0.0)

    def scatter(x: np.ndarray) -> np.ndarray:
        y = white.centred(x)
        return y.T @ y

    covariance = summed(distinct, scatter, d) / n
    values, vectors = components((covariance + covariance.T) / 2)
    if not len(values):
        drop_scratch(spark, distinct)
        return None
    white = Whitening(n, sums, values[:most], vectors[:, :most], float(np.trace(covariance)))
    k = len(white.values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = white.whitened(x)
        return np.vstack((w.T @ w, w.sum(0)))

    found = summed(distinct, moments, k) / n
    white.identity_error = float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())
    drop_scratch(spark, distinct)
    return white


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component, at most ``most``.

    ``integer_vectors`` says which rows count. Repeated rows have theirs each and count once in the fit; a null vec_id is kept. Of vectors that
    vary in fewer dimensions there are fewer components; a table without rows, or of one distinct vector, has none and
    gives no rows. A deviation that needs more than 64 bits is null. Other columns are ignored.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = integer_vectors(vectors)
    white = fit(rows, most)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if white is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(white)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        k = len(w.values)
        for batch in batches:
            x = _matrix(batch.column(1))
            for lo in range(0, len(x), 4096):
                part = x[lo : lo + 4096]
                row = pa.array(np.repeat(np.arange(len(part)), k))
                size = len(part) * k
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, len(part)).take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))), pa.array(np.full(size, w.n)),
                    pa.array(w.deviations(part), pa.int64()).take(row), pa.array(w.whitened(part).ravel()), pa.array(np.tile(w.values / w.trace, len(part))), pa.array(np.full(size, w.identity_error)),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def op12_cholesky_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings whitened; see ``whiten``."""
    return whiten(table(spark, sf_dir, "embeddings"))
