"""Whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred rows, with full reorthogonalisation.

Each distinct vector counts once. Steps alternate products with the centred rows X: u ~ X v, then v ~ X'u, so that X = U B V'
with B upper bidiagonal; its small singular value decomposition, on the driver, gives components and deviations. A step is
one pass over the rows. The left vectors are as long as the table and are never kept: each is X c for a coefficient vector
c as short as a row, so that a pass computes all earlier ones again and takes the new one's products with them. What is not
orthogonal is taken off, and a pass is repeated where that was more than rounding; right vectors are held by the driver.

Where a step finds nothing new (singular values that are equal, or zero), the next starts from a random direction orthogonal to
all before. Steps go on until all dimensions are spanned: no component is missed, however close two deviations are.

Passes read the distinct vectors packed into blocks, in files of FILE vectors; each task returns sums of a row's length, which
are added in tasks again where there are many.

Nulls: a vector that is null or holds null or non-finite entries has no row in the result; a null vec_id is kept as it is.
Only vectors of the most frequent size (of equally frequent ones the greatest) take part. Repeated rows and ids each have
their own rows. Components without deviation aren't returned, so equal vectors alone, or a single one, give no rows, as an
empty table does. Deviations that 64 bits can't hold are an error. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: What is added to entries after scaling by SCALE; components returned.
OFFSET, SCALE, MOST = 1_000_000, 64, 16
#: Vectors of a packed block and of a file of them; sums that are added in one task, or by the driver.
BLOCK, FILE, FAN = 8192, 1 << 20, 256
#: What counts as nothing, as a share of the largest entry of B, and how orthogonal new left vectors are.
NOTHING, ORTHOGONAL = 1e-10, 1e-9
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def entries(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of vectors (vec_id, embedding) with finite entries, of their most frequent size."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: c.cast("double")).alias("e")).where("e IS NOT NULL")
    rows = rows.where(F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    sizes = rows.groupBy(F.size("e").alias("size")).count().orderBy(F.col("count").desc(), F.col("size").desc()).first()
    rows = rows.where(F.size("e") == (sizes["size"] if sizes else 0))
    return rows.select("vec_id", F.transform("e", lambda c: F.floor(c * SCALE) + OFFSET).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed blocks of x, less OFFSET, with their sums."""
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK):
            x = _matrix(batch.column(0).slice(i, BLOCK)) - OFFSET
            yield pa.RecordBatch.from_arrays([pa.array([len(x)]), pa.array([x.astype("<i8").tobytes()], pa.binary()), pa.array([x.sum(0).tolist()], pa.list_(pa.int64()))], names=["n", "x", "s"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = [_matrix(batch.column(0)).sum(0) for batch in batches if batch.num_rows]
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array([np.sum(sums, axis=0).tolist()], pa.list_(pa.float64()))], names=["s"])


class Rows:
    """Distinct vectors in packed blocks: their number n, sums (of entries less OFFSET) and mean."""

    def __init__(self, x: DataFrame):
        spark = x.sparkSession
        packed = written(x.select("x").distinct().mapInArrow(_blocks, "n long, x binary, s array<long>"), "blocks")
        some = packed.agg(F.sum("n"), F.max(F.size("s"))).first()
        self.n, self.d = int(some[0] or 0), int(some[1] or 0)
        self.files = -(-self.n // FILE) or 1
        self.blocks = written(packed.repartition(self.files), "fit")
        s = self.blocks.select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
        self.sums = np.zeros(self.d, dtype=np.int64)
        for r in s.collect():
            self.sums[r.i] = r.v
        self.mean = self.sums / max(self.n, 1)
        self.spark = spark

    def total(self, of) -> np.ndarray:
        """The sum, over all blocks, of of(centred block), an array of one length."""
        d, mean = self.d, self.mean

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = [of(np.frombuffer(x.as_py(), dtype="<i8").reshape(-1, d) - mean) for batch in batches for x in batch.column(0)]
            if own:
                yield pa.RecordBatch.from_arrays([pa.array([np.sum(own, axis=0).tolist()], pa.list_(pa.float64()))], names=["s"])

        sums, many = self.blocks.select("x").mapInArrow(run, "s array<double>"), self.files
        while many > FAN:
            many = -(-many // FAN)
            sums = sums.repartition(many).mapInArrow(_added, "s array<double>")
        return np.sum([r.s for r in sums.collect()], axis=0)


def _product(w: np.ndarray, earlier: np.ndarray):
    """Of a block X: |Xw|^2, X'(Xw), and the products of Xw with the earlier left vectors."""

    def of(x: np.ndarray) -> np.ndarray:
        z = x @ w
        return np.concatenate([[z @ z], x.T @ z, (x @ earlier).T @ z])

    return of


def bidiagonal(rows: Rows, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Right vectors V (columns) and upper bidiagonal B with X = U B V' for the centred rows X."""
    d, r = rows.d, np.random.default_rng(seed)
    v, b = np.zeros((d, d)), np.zeros((d, d))
    left = np.zeros((d, 0))  # coefficients c of the left vectors X c
    back = np.zeros((d, 0))  # and their products X'(X c)
    beta, last = 0.0, None

    def fresh(j: int) -> np.ndarray:
        """A unit vector orthogonal to the first j right vectors."""
        x = r.normal(size=d)
        for _ in range(3):
            x -= v[:, :j] @ (v[:, :j].T @ x)
            x /= np.linalg.norm(x)
        return x

    v[:, 0] = fresh(0)
    for j in range(d):
        w = v[:, j].copy()
        if last is not None:
            w -= beta * left[:, last]
        scale = max(np.abs(b).max(), 1e-300)
        while True:
            sums = rows.total(_product(w, left))
            size, image, along = np.sqrt(max(sums[0], 0)), sums[1 : d + 1], sums[d + 1 :]
            if size <= NOTHING * scale or (np.abs(along) <= ORTHOGONAL * size).all():
                break
            w -= left @ along
        if size <= NOTHING * scale or size == 0:
            alpha, right, last = 0.0, np.zeros(d), None
        else:
            alpha, last = size, left.shape[1]
            left, back = np.column_stack([left, w / size]), np.column_stack([back, image / size])
            right = back[:, last] - alpha * v[:, j]
        b[j, j] = alpha
        if j + 1 == d:
            break
        for _ in range(2):
            right -= v[:, : j + 1] @ (v[:, : j + 1].T @ right)
        beta = np.linalg.norm(right)
        if beta <= NOTHING * max(scale, alpha):
            beta, v[:, j + 1] = 0.0, fresh(j + 1)
            last = None
        else:
            v[:, j + 1] = right / beta
            b[j, j + 1] = beta
    return v, b


def components(rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvectors (columns) and eigenvalues of the rows' covariance, by falling eigenvalue."""
    v, b = bidiagonal(rows)
    _, s, right = np.linalg.svd(b)
    return v @ right.T, s**2 / rows.n


def _whitened(rows: Rows, axes: np.ndarray, e: np.ndarray, explained: np.ndarray, error: float):
    n, sums, mean, most = rows.n, rows.sums, rows.mean, len(e)
    project = axes / np.sqrt(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                x = _matrix(batch.column(1).slice(i, BLOCK)) - OFFSET
                far = max((abs(int(v)) * n + abs(int(s)) for v, s in zip(np.abs(x).max(0), sums, strict=True)), default=0)
                if far >= 1 << 63:
                    raise OverflowError("deviations beyond 64 bits")
                off = n * x - sums
                if len(off) and x.shape[1] * int(np.abs(off).max()) ** 2 >= 1 << 63:
                    exact = [sum(int(o) ** 2 for o in row) for row in off]  # each sum may still fit
                    if max(exact) >= 1 << 63:
                        raise OverflowError("deviations beyond 64 bits")
                    deviation = np.array(exact, dtype=np.int64)
                else:
                    deviation = (off * off).sum(1)
                y = (x - mean) @ project
                ids = batch.column(0).slice(i, BLOCK).take(pa.array(np.repeat(np.arange(len(x)), most)))
                same = lambda value: pa.array(np.full(len(x) * most, value))  # noqa: B023, E731
                columns = [ids, pa.array(np.tile(np.arange(1, most + 1, dtype=np.int32), len(x))), same(n), pa.array(np.repeat(deviation, most)), pa.array(y.ravel()), pa.array(np.tile(explained, len(x))), same(error)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in WHITENED.split(", ")])

    return run


def whitened(vectors: DataFrame, most: int = MOST) -> DataFrame:
    """WHITENED of vectors (vec_id, embedding): a row for each vector and each of its first components."""
    x = entries(vectors)
    rows = Rows(x)
    if rows.n == 0 or rows.d == 0:
        return vectors.sparkSession.createDataFrame([], WHITENED)
    axes, e = components(rows)
    trace = e.sum()
    real = int((e > trace * 1e-13).sum()) if trace > 0 else 0
    axes, e = axes[:, : min(most, real)], e[: min(most, real)]
    if not len(e):
        return vectors.sparkSession.createDataFrame([], WHITENED)
    project = axes / np.sqrt(e)

    def covariance(block: np.ndarray) -> np.ndarray:
        y = block @ project
        return (y.T @ y).ravel()

    error = float(np.abs(rows.total(covariance).reshape(len(e), -1) / rows.n - np.eye(len(e))).max())
    return x.select("vec_id", "x").mapInArrow(_whitened(rows, axes, e, e / trace, error), WHITENED)


def op13_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings by up to 16 whitened components."""
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
