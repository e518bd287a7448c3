"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows X.

X is never turned into a covariance matrix, and left vectors are never stored: they are kept as small vectors w with
u = X w, so a step is one pass over the rows in which each block goes through u = X w and then Xᵀ u, and sums of the
length of a vector leave a task. Both sides are orthogonalised against all earlier vectors, twice: the right ones
on the driver, the left ones by their inner products, which come out of the same pass. A vanished vector is
replaced by a fresh direction, so equal or missing singular values do not end the process early. The bidiagonal matrix
is as small as the vectors are long; its decomposition gives components and deviations.

Entries are counted in 64ths (x = floor(64 c) + 1,000,000). Sums, centred rows times n, and deviations are exact
integers, in 64 bits where these suffice for the rows of a block, else in Python's. Up to `steps` passes are made (the
length of a vector by default: components that lie close together need all of them), and then two for the error.

Defined results: rows whose vector is null, empty, or holds a null, a non-finite entry or one beyond 2**55 are left out, as are
rows of another length than the most frequent one (the longer, if equally frequent). Null, repeated and clashing
ids stay rows of their own. Directions in which rows do not differ have no component, so fewer than `k` may be returned,
and a table of one or no vector gives no rows. A deviation beyond 64 bits is null. Other columns are not read. Vectors
are handled in Arrow batches of at most 10,000 rows, some 80 kB for each dimension.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import written

BASE, SCALE, COMPONENTS = 1_000_000, 64, 32
_LIMIT = 1 << 62


def counted_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x) of the rows that count, written; x is an array of longs."""
    v = F.col("v")
    sound = F.coalesce(F.size(v) > 0, F.lit(False)) & F.forall(v, lambda c: F.coalesce(F.abs(c) < float(1 << 55), F.lit(False)))  # NaN is above every number
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(sound)
    rows = written(rows.select("id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + BASE).alias("x")))
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(2).collect()
    return rows if len(sizes) < 2 else rows.where(F.size("x") == sizes[0]["d"])


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.int64)


def summed(rows: DataFrame, kernel: Callable[[np.ndarray], list], exact: bool = False) -> list:
    """Sums over all rows of what kernel gives for a block of x, a list of always the same length: each task adds up its own blocks, then slots are summed apart.

    exact: the numbers are Python integers, and are summed as decimals."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = kernel(matrix(batch.column(0)))
                own = own if exact else np.asarray(own, np.float64)
                total = own if total is None else [a + b for a, b in zip(total, own, strict=True)] if exact else total + own
        if total is not None:
            values = pa.array([Decimal(v) for v in total], pa.decimal128(38, 0)) if exact else pa.array(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), values], names=["slot", "value"])

    parts = rows.select("x").mapInArrow(partial, f"slot int, value {'decimal(38,0)' if exact else 'double'}")
    got = sorted(map(tuple, parts.groupBy("slot").agg(F.sum("value").cast("decimal(38,0)" if exact else "double").alias("value")).collect()))
    return [int(v) if exact else v for _, v in got]


class Centre:
    """Number of rows and sums of each dimension, and the rows measured from them."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.floor = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s - n * int(f) for s, f in zip(sums, self.floor, strict=True)], np.int64)

    def gaps(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: 64-bit integers where they suffice, else Python's."""
        from_floor = x - self.floor
        if x.size and (int(np.abs(from_floor).max()) + 1) * self.n >= _LIMIT:
            return from_floor.astype(object) * self.n - self.rest.astype(object)
        return from_floor * self.n - self.rest

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (self.gaps(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int]:
        g = self.gaps(x)
        if g.dtype != object and g.size and int(np.abs(g).max()) ** 2 * g.shape[1] >= _LIMIT:
            g = g.astype(object)
        return [int(v) for v in (g * g).sum(axis=1)]


def centre(rows: DataFrame) -> Centre | None:
    """None of an empty table."""

    def kernel(x: np.ndarray) -> list[int]:  # halves of 31 bits, so that sums of 2**32 rows of a block fit
        low, high = (x & 0x7FFFFFFF).sum(axis=0), (x >> 31).sum(axis=0)
        return [len(x), *((int(h) << 31) + int(v) for v, h in zip(low, high, strict=True))]

    got = summed(rows, kernel, exact=True)
    return Centre(got[0], got[1:]) if got else None


def _against(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """v less its parts along the basis; done twice, which is enough for rounding."""
    for _ in range(2 if basis else 0):
        b = np.array(basis)
        v = v - b.T @ (b @ v)
    return v


def bidiagonalised(product: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], d: int, steps: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(B, V) with X V = U B, B upper bidiagonal, for X known only by product(W) = (Wᵀ Xᵀ X w, Xᵀ X w) of the last row w of W.

    W holds the small vectors of the left ones, X w = u; scale is the norm of X. A step asks for one product, and for another only where rounding made
    the left vector lean on earlier ones."""
    rng, tiny = np.random.default_rng(7), scale * 1e-13
    fresh = lambda basis: (lambda v: v / np.linalg.norm(v))(_against(rng.standard_normal(d), basis))
    right, left, backs, alphas, betas = [fresh([])], [], [], [], []  # backs: Xᵀ u of each left vector
    while True:
        w = right[-1] - (betas[-1] * left[-1] if left and betas[-1] else 0)
        for _ in range(3):
            inner, back = product(np.array([*left, w]))
            alpha = np.sqrt(max(inner[-1], 0.0))
            lean = inner[:-1]
            if alpha <= tiny or not len(lean) or np.abs(lean).max() <= 1e-15 * alpha:
                break
            w = w - lean @ np.array(left)
            if np.abs(lean).max() <= 1e-12 * alpha:  # the rest of it is below rounding: its effect on back is known
                back = back - lean @ np.array(backs)
                alpha = np.sqrt(max(inner[-1] - lean @ lean, 0.0))
                break
        if alpha <= tiny:
            alpha, w, back = 0.0, np.zeros(d), np.zeros(d)
        else:
            w, back = w / alpha, back / alpha
        backs.append(back)
        left.append(w)
        alphas.append(alpha)
        if len(right) == steps:
            return np.diag(alphas) + np.diag(betas, 1), np.array(right).T
        v = _against(back - alpha * right[-1], right)
        beta = np.linalg.norm(v)
        if beta <= tiny:
            betas.append(0.0)
            right.append(fresh(right))
        else:
            betas.append(beta)
            right.append(v / beta)


def fitted(rows: DataFrame, at: Centre, k: int = COMPONENTS, steps: int | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, components as rows, trace) of the covariance of rows: the first k that are not null."""
    d = len(at.floor)
    trace = float(summed(rows, lambda x: [np.square(at.rows(x)).sum()])[0]) / at.n
    if not trace:
        return np.zeros(0), np.zeros((0, d)), 0.0

    def product(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def kernel(x: np.ndarray) -> np.ndarray:
            y = at.rows(x)
            u = y @ w.T
            return np.concatenate((u.T @ u[:, -1], y.T @ u[:, -1]))

        got = np.array(summed(rows, kernel))
        return got[: len(w)], got[len(w) :]

    b, v = bidiagonalised(product, d, min(steps or d, d), float(np.sqrt(trace * at.n)))
    _, sigma, q = np.linalg.svd(b)
    e = sigma**2 / at.n
    keep = (np.arange(len(e)) < k) & (sigma > sigma[0] * 1e-9)
    parts = (q @ v.T)[keep]
    return e[keep], parts * np.sign(parts[np.arange(len(parts)), np.abs(parts).argmax(axis=1)])[:, None], trace


def whitened(table: DataFrame, k: int = COMPONENTS, steps: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every row that counts and each component."""
    rows = counted_vectors(table, id_col, vector_col)
    id_type = table.schema[id_col].dataType.simpleString()
    kind = f"id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    named = lambda df: df.withColumnRenamed("id", id_col)
    if (at := centre(rows)) is None:
        return named(table.sparkSession.createDataFrame([], kind))
    e, parts, trace = fitted(rows, at, k, steps)
    m = len(e)
    if not m:
        return named(table.sparkSession.createDataFrame([], kind))
    onto = (parts / np.sqrt(e)[:, None]).T
    mean = np.array(summed(rows, lambda x: (at.rows(x) @ onto).sum(axis=0))) / at.n

    def second(x: np.ndarray) -> np.ndarray:
        z = at.rows(x) @ onto - mean
        return (z.T @ z).ravel()

    error = float(np.abs(np.array(summed(rows, second)).reshape(m, m) / at.n - np.eye(m)).max())
    explained = e / trace

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows_in = batch.num_rows
            if rows_in:
                x = matrix(batch.column(1))
                deviation = [v if v < 1 << 63 else None for v in at.deviations(x)]
                each = np.repeat(np.arange(rows_in), m)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), rows_in)), pa.array(np.full(len(each), at.n)),
                        pa.array(deviation, pa.int64()).take(pa.array(each)), pa.array((at.rows(x) @ onto).ravel()), pa.array(np.tile(explained, rows_in)), pa.array(np.full(len(each), error)),
                    ],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return named(rows.mapInArrow(kernel, kind))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
