"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation of their centred rows.

With X the centred rows, X V = U B: V's columns are orthonormal directions, U's orthonormal
combinations of rows, B is upper bidiagonal. A step is one pass over the rows: the next column
of X V, less what U already has of it, and X' times the result. V and B are as large as a vector
is long and stay on the driver; U is as long as the table and stays with the rows. The singular
vectors of B, turned by V, are the principal directions of X, at the precision of X itself and
not of its square.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from .embeddings import _matrix
from .shared import prepare_workers, staged

#: x = floor(STEPS * c) + SHIFT, the whole number that an entry c becomes (fixed by the contract).
STEPS, SHIFT = 64, 1_000_000
#: Whole numbers below this are exact in doubles; larger ones are kept as Python's.
_EXACT = 1 << 53


def _whole_numbers(column: pa.Array, wide: int) -> np.ndarray:
    """Rows of whole numbers, vectors shorter than ``wide`` as if they ended in zeros."""
    c = _matrix(column)
    c = np.floor(np.pad(c, ((0, 0), (0, wide - c.shape[1]))) * STEPS)
    if np.abs(c).max(initial=0) < _EXACT:
        return c.astype(np.int64) + SHIFT
    return np.array([[int(v) + SHIFT for v in row] for row in c], object).reshape(c.shape)


def _added(rows: DataFrame) -> np.ndarray:
    """Element-wise sums of ``sums array<double>`` over rows, added up on the executors."""
    total = (rows.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("sum"))
             .orderBy("pos").collect())
    return np.array([r["sum"] for r in total])


@dataclass(frozen=True)
class _Left:
    """How a row's entries of U follow from the row: each column of X V, less its share in the
    columns before (``shares``, one vector per column), over its length (``alphas``)."""
    right: np.ndarray
    alphas: list[float]
    shares: list[np.ndarray]

    def columns(self, z: np.ndarray) -> np.ndarray:
        u = z @ self.right[:, :len(self.alphas)]
        for j, (alpha, share) in enumerate(zip(self.alphas, self.shares, strict=True)):
            u[:, j] -= u[:, :j] @ share
            u[:, j] = u[:, j] / alpha if alpha else 0
        return u


def _pass(rows: DataFrame, left: _Left, v: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """``(U'p, X'p, p'p)`` of p = X v less what the columns of U have of it by ``share``."""
    j, wide = len(left.alphas), len(v)

    def summed(batches):
        sums = np.zeros(j + wide + 1)
        for batch in batches:
            z = _rows_of(batch.column(0), wide)
            u = left.columns(z)
            p = z @ v - u @ share
            sums += np.concatenate([u.T @ p, z.T @ p, [p @ p]])
        yield pa.RecordBatch.from_arrays([pa.array([sums], pa.list_(pa.float64()))], ["sums"])

    sums = _added(rows.select("z").mapInArrow(summed, "sums array<double>"))
    return sums[:j], sums[j:j + wide], float(sums[-1])


def _rows_of(column: pa.Array, wide: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist())).reshape(-1, wide)


def bidiagonalise(rows: DataFrame, wide: int, steps: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """``(V, B)`` of ``steps`` Golub-Kahan-Lanczos steps on the centred rows ``z`` (doubles as bytes).

    Both sides are reorthogonalised against all their earlier columns, on every step. On U's
    side a second pass follows where the first took away more than a rounding's worth: what it
    leaves is of the order of 1e-16 of what it took. Where a side is exhausted (an entry of B is zero but for rounding) the process goes on
    from a new direction, so repeated and zero singular values are found as well.
    """
    rng = np.random.default_rng(seed)
    right, b = np.zeros((wide, steps)), np.zeros((steps, steps))
    images = np.zeros((wide, 0))  # X'u of each column of U
    alphas, shares, beta, size = [], [], 0.0, 0.0

    def orthogonal(r: np.ndarray, j: int) -> np.ndarray:
        for _ in range(2):
            r = r - right[:, :j] @ (right[:, :j].T @ r)
        return r

    def fresh_direction(j: int) -> np.ndarray:
        r = orthogonal(rng.standard_normal(wide), j)
        r = orthogonal(r / np.linalg.norm(r), j)
        return r / np.linalg.norm(r)

    v = fresh_direction(0)
    for j in range(steps):
        right[:, j] = v
        left, share = _Left(right[:, :j], alphas, shares), np.zeros(j)
        if j:
            share[-1] = beta
        for _ in range(2):
            held, image, squared = _pass(rows, left, v, share)
            share = share + held
            # What the reorthogonalised column gives follows from the pass over the one before it.
            image, squared = image - images @ held, max(0.0, squared - float(held @ held))
            if not j or np.abs(held).max() <= 1e-9 * np.sqrt(squared):
                break
        alpha = float(np.sqrt(squared))
        size = max(size, alpha, beta)
        if alpha <= 1e-13 * size or not alpha:
            alpha, image = 0.0, np.zeros(wide)
        alphas, shares = [*alphas, alpha], [*shares, share]
        image = image / alpha if alpha else image
        images = np.column_stack([images, image])
        b[j, j] = alpha
        if j + 1 < steps:
            r = orthogonal(image - alpha * v, j + 1)
            beta = float(np.linalg.norm(r))
            if beta <= 1e-13 * size:
                beta, v = 0.0, fresh_direction(j + 1)
            else:
                v = r / beta
            b[j, j + 1] = beta
    return right, b


def whiten(vectors: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding",
           components: int = 32) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``, one row for each
    remaining row of ``vectors`` and component.

    Rows with a null vector or one with null or non-finite entries are left out; all others
    are the fit list of ``n`` rows. An entry c becomes x = floor(64 * c) + 1000000. ``deviation`` is
    the sum over dimensions of (n * x - S)^2, S the dimension's sum, exact (beyond a long: its
    end). Components are unit eigenvectors of the covariance (divisor n), numbered by falling
    eigenvalue e; ``whitened`` is the centred row on the component over sqrt(e), ``explained`` e
    over the trace, ``identity_error`` the largest entry by which the covariance of
    all whitened columns differs from the identity, measured over all rows.

    The bidiagonalisation is carried through, as many steps as a vector is long, so that no
    eigenvalue is missed because it repeats; a step is one pass, or two, over the rows.
    Components without variance (all rows equal, fewer rows than dimensions) have no scale and
    are not returned; no rows give none.
    Shorter vectors count as ending in zeros, an empty one as zeros. Repeated rows, shared and
    null ids are rows as any other; other columns are not read.
    """
    spark = vectors.sparkSession
    prepare_workers(spark)
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"),
                          F.col(vector_column).cast("array<double>").alias("c")).where(
        "c IS NOT NULL AND forall(c, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    n, wide = rows.agg(F.count("*"), F.max(F.size("c"))).first()
    out = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
           "identity_error double")
    if not n or not wide:
        return spark.createDataFrame([], out)

    def summed(batches):
        sums = np.zeros(wide, object)
        for batch in batches:
            sums = sums + _whole_numbers(batch.column(0), wide).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array([[str(s) for s in sums]], pa.list_(pa.string()))], ["sums"])

    parts = rows.select("c").mapInArrow(summed, "sums array<string>")
    totals = (parts.select(F.posexplode("sums")).groupBy("pos")
              .agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("sum")).orderBy("pos").collect())
    sums = np.array([int(r["sum"]) for r in totals], object)

    def centred(batches):
        for batch in batches:
            x = _whole_numbers(batch.column(1), wide)
            most = int(max(np.abs(x).max(initial=0) * n + np.abs(sums).max(), 1))
            narrow = x.dtype != object and most < 1 << 62
            apart = x * n - sums.astype(np.int64) if narrow else x.astype(object) * n - sums
            if narrow and int(np.abs(apart).max(initial=0)) ** 2 * wide < 1 << 63:
                deviation = (apart ** 2).sum(axis=1)
            else:
                deviation = np.array([min(sum(int(a) ** 2 for a in row), (1 << 63) - 1) for row in apart], np.int64)
            z = apart.astype(np.float64) / n
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(deviation, pa.int64()), pa.array([r.tobytes() for r in z], pa.binary())],
                ["vec_id", "deviation", "z"])

    table = staged(rows.mapInArrow(centred, "vec_id long, deviation long, z binary"), "centred")
    # Read on every pass; a lost copy is read from the shared folder again.
    held = table.select("z").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        right, b = bidiagonalise(held, wide, wide)
        _, sigma, turned = np.linalg.svd(b)
        rank = int((sigma > max(n, wide) * np.finfo(float).eps * sigma[0]).sum())
        count = min(components, rank)
        directions = (right @ turned.T)[:, :count]
        deviations, trace = sigma[:count] / np.sqrt(n), float((sigma ** 2).sum()) / n
        axes = directions / deviations

        def moments(batches):
            total = np.zeros((count + 1) * count)
            for batch in batches:
                w = _rows_of(batch.column(0), wide) @ axes
                total += np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["sums"])

        if not count:
            return spark.createDataFrame([], out)
        got = _added(held.mapInArrow(moments, "sums array<double>")) / n
    finally:
        held.unpersist()
    mean, second = got[:count], got[count:].reshape(count, count)
    error = float(np.abs(second - np.outer(mean, mean) - np.eye(count)).max())
    explained = deviations ** 2 / trace

    def projected(batches):
        for batch in batches:
            w = _rows_of(batch.column(2), wide) @ axes
            size = len(w)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(size), count))),
                pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), size)),
                pa.array(np.full(size * count, n, np.int64)),
                batch.column(1).take(pa.array(np.repeat(np.arange(size), count))),
                pa.array(w.ravel()), pa.array(np.tile(explained, size)), pa.array(np.full(size * count, error))],
                [c.split()[0] for c in out.split(", ")])

    return table.mapInArrow(projected, out)
