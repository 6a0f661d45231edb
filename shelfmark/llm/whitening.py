r"""Embedding whitening by a tiled covariance.

Every usable vector becomes integers ``x = floor(256 * c) + 0``; the fit list holds each distinct x vector once.  It is
cut into row blocks of ``BLOCK_ROWS`` vectors and column blocks of ``tile`` dimensions.  The covariance is summed tile by
tile: the column blocks are shuffled by row block, each pair of column blocks of a row block meets once, is centred on the
means and multiplied, and the products are summed per tile key (i, j).  A task adds up its own products before they leave
it, so the last shuffle has one row per task, tile and row of the tile at most, whatever the number of vectors.  The matrix
of dimensions x dimensions is assembled and decomposed on the driver; of the vectors nothing ever gets there.

Means, deviations and the fit list are exact: sums are of whole numbers, and an overflow of a long is an error, never a
wrong figure.  Centring and products are in double precision.

Defined results: rows are dropped whose vector is null, holds null, NaN or infinite entries, or has another length than
most rows (of equally frequent lengths the greater); null ids and repeated rows stay; extra columns are ignored; an empty
table gives no rows.  Components beyond the rank of the covariance (eigenvalue of rounding size) have null ``whitened``
and ``explained`` 0, and take no part in ``identity_error``; ``explained`` is null where all variance is 0.  The sign of
a component is such that its entry of greatest size is positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, settle

#: Dimensions of a column block, vectors of a row block, and entries that a row block has at most (beyond it fewer vectors).
TILE, BLOCK_ROWS, BLOCK_ENTRIES = 32, 2048, 1 << 20
COMPONENTS = 4
LONG_MAX = float(1 << 62)


@dataclass
class Whitening:
    """A fitted whitening: x-vectors of the fit list, their sums, the covariance and its components by falling eigenvalue."""

    n: int
    sums: np.ndarray  # long, per dimension
    covariance: np.ndarray
    eigenvalues: np.ndarray
    components: np.ndarray  # a row each, of length 1
    identity_error: float | None = None

    @property
    def trace(self) -> float:
        return float(np.trace(self.covariance))

    @property
    def rank(self) -> int:
        top = float(self.eigenvalues[0]) if len(self.eigenvalues) else 0.0
        return int((self.eigenvalues > top * len(self.eigenvalues) * 1e-13).sum()) if top > 0 else 0

    def projection(self, k: int) -> np.ndarray:
        """(dimensions x k): what centred x-vectors are multiplied with; of the components beyond the rank NaN."""
        k = min(k, len(self.eigenvalues))
        e = np.where(np.arange(k) < self.rank, self.eigenvalues[:k], np.nan)
        return (self.components[:k] / np.sqrt(e)[:, None]).T


def finite(vector: str) -> Column:
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, entry)


def usable(embeddings: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """Rows with a finite vector of the usual length, and that length (0 if there is no such row)."""
    good = embeddings.where(finite(vector))
    usual = good.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    dim = usual["size"] if usual else 0
    return good.where(F.size(vector) == dim), dim


def quantised(column: pa.Array, dim: int) -> np.ndarray:
    """(rows x dim) whole numbers floor(256 * c) of an Arrow column of lists without nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    scaled = np.floor(flat * 256)
    if len(scaled) and np.abs(scaled).max() >= LONG_MAX:
        raise OverflowError("an entry of a vector does not fit a long")
    return scaled.astype(np.int64).reshape(-1, dim)


def packed(matrix: np.ndarray) -> tuple[bytes, int]:
    """A matrix of whole numbers in the least number of bytes for each, and that number."""
    most = int(np.abs(matrix).max(initial=0))
    kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
    return matrix.astype(kind).tobytes(), np.dtype(kind).itemsize


def fit_list(vectors: DataFrame, dim: int, vector: str) -> DataFrame:
    """(x binary): each distinct x vector once.  The width of a packed vector follows from its length alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = quantised(batch.column(0), dim)
            yield pa.RecordBatch.from_arrays([pa.array([packed(row)[0] for row in rows], pa.binary())], ["x"])

    return vectors.select(vector).mapInArrow(run, "x binary").distinct()


def row_blocks(distinct: DataFrame, dim: int, tile: int) -> DataFrame:
    """(block long, n int, width int, columns array<binary>), settled: the fit list as row blocks of packed column blocks."""
    most = max(1, min(BLOCK_ROWS, BLOCK_ENTRIES // dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_pylist()
            for begin in range(0, len(rows), most):
                part = rows[begin : begin + most]
                matrix = np.stack([np.frombuffer(x, f"i{len(x) // dim}").astype(np.int64) for x in part])
                width = packed(matrix)[1]
                blocks = [np.ascontiguousarray(matrix[:, a : a + tile]).astype(f"i{width}").tobytes() for a in range(0, dim, tile)]
                yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int32()), pa.array([width], pa.int32()), pa.array([blocks], pa.list_(pa.binary()))], ["n", "width", "columns"])

    cut = distinct.mapInArrow(run, "n int, width int, columns array<binary>")
    # The number of a block is fixed by being written.
    return settle(cut.select(F.monotonically_increasing_id().alias("block"), "*"), "blocks")


def block_matrix(data: bytes, width: int, n: int) -> np.ndarray:
    return np.frombuffer(data, f"i{width}").reshape(n, -1)


def added(total: np.ndarray, part: np.ndarray) -> np.ndarray:
    if float(np.abs(total).max()) + float(np.abs(part).max()) >= LONG_MAX:
        raise OverflowError("the sum of a dimension does not fit a long")
    return total + part


def sums(blocks: DataFrame, dim: int) -> tuple[int, np.ndarray]:
    """(vectors, sum per dimension) of the fit list, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, np.int64)
        for batch in batches:
            for rows, width, columns in zip(*(batch.column(c).to_pylist() for c in ("n", "width", "columns")), strict=True):
                n += rows
                total = added(total, np.concatenate([block_matrix(c, width, rows).sum(axis=0, dtype=np.int64) for c in columns]))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dim)), pa.array(np.concatenate([[n], total]))], ["at", "total"])

    parts = blocks.select("n", "width", "columns").mapInArrow(run, "at long, total long")
    found = dict(map(tuple, parts.groupBy("at").agg(F.sum("total")).collect()))
    return found.get(-1, 0), np.array([found.get(i, 0) for i in range(dim)], np.int64)


def covariance(blocks: DataFrame, dim: int, n: int, total: np.ndarray, tile: int) -> np.ndarray:
    """The covariance of the fit list: products of centred column blocks, summed per tile."""
    mean = total / n
    # A row per (row block, column block), shuffled by row block; both sides of the join are the same exchange.
    columns = blocks.select("block", "n", "width", F.posexplode("columns").alias("at", "data"))
    left = columns.select("block", "n", "width", F.col("at").alias("i"), F.col("data").alias("a"))
    pairs = left.join(columns.select("block", F.col("at").alias("j"), F.col("data").alias("b")), "block").where("i <= j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("n", "width", "i", "j", "a", "b")), strict=True):
                rows, width, i, j, a, b = (v.as_py() for v in row)
                x = block_matrix(a, width, rows) - mean[i * tile : (i + 1) * tile]
                y = block_matrix(b, width, rows) - mean[j * tile : (j + 1) * tile]
                tiles[i, j] = tiles.get((i, j), 0.0) + x.T @ y
        for (i, j), product in tiles.items():
            down, across = np.indices(product.shape)
            yield pa.RecordBatch.from_arrays([pa.array((i * tile + down).ravel()), pa.array((j * tile + across).ravel()), pa.array(product.ravel())], ["row", "col", "v"])

    products = pairs.select("n", "width", "i", "j", "a", "b").mapInArrow(run, "row long, col long, v double")
    summed = products.groupBy("row", "col").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((dim, dim))
    row, col = summed["row"].to_numpy(), summed["col"].to_numpy()
    out[row, col] = summed["v"].to_numpy() / n
    out[col, row] = out[row, col]
    return out


def identity_error(blocks: DataFrame, fitted: Whitening, k: int) -> float | None:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity, over k components of the rank."""
    k = min(k, fitted.rank)
    if not k:
        return None
    mean, project = fitted.sums / fitted.n, fitted.projection(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for rows, width, columns in zip(*(batch.column(c).to_pylist() for c in ("n", "width", "columns")), strict=True):
                y = (np.hstack([block_matrix(c, width, rows) for c in columns]) - mean) @ project
                first, second = first + y.sum(axis=0), second + y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + k * k)), pa.array(np.concatenate([first, second.ravel()]))], ["at", "v"])

    parts = blocks.select("n", "width", "columns").mapInArrow(run, "at long, v double")
    found = dict(map(tuple, parts.groupBy("at").agg(F.sum("v")).collect()))
    flat = np.array([found.get(i, 0.0) for i in range(k + k * k)]) / fitted.n
    # The vectors were centred before the product; what is left of their mean is of rounding size.
    rest = flat[k:].reshape(k, k) - np.outer(flat[:k], flat[:k]) - np.eye(k)
    return float(np.abs(rest).max())


def decompose(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and their unit eigenvectors as rows, the entry of greatest size positive."""
    values, vectors = np.linalg.eigh(matrix)
    vectors = vectors.T[::-1]
    largest = vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)]
    return np.maximum(values[::-1], 0.0), vectors * np.where(largest < 0, -1.0, 1.0)[:, None]


def fit(vectors: DataFrame, dim: int, vector: str = "embedding", tile: int = TILE, k: int = COMPONENTS) -> Whitening | None:
    """Whitening of usable vectors; None if there are none.  ``identity_error`` is over the first k components."""
    if not dim:
        return None
    blocks = row_blocks(fit_list(vectors, dim, vector), dim, tile)
    n, total = sums(blocks, dim)
    if not n:
        return None
    fitted = Whitening(n, total, matrix := covariance(blocks, dim, n, total, tile), *decompose(matrix))
    fitted.identity_error = identity_error(blocks, fitted, k)
    discard(blocks)
    return fitted


def whiten(vectors: DataFrame, fitted: Whitening, vector: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """vec_id, deviation (exact), whitened (k doubles, NaN beyond the rank) of each usable row."""
    dim, n = len(fitted.sums), fitted.n
    total, mean, project = fitted.sums, fitted.sums / n, fitted.projection(k)
    size = project.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = quantised(batch.column(vector), dim)
            furthest = float(np.abs(x).max(initial=0)) * n + float(np.abs(total).max(initial=0))
            if furthest < LONG_MAX and furthest**2 * dim < LONG_MAX:
                deviation = pa.array(((x * n - total) ** 2).sum(axis=1))
            else:  # whole numbers of any size; a sum beyond a long is an error of Arrow's
                deviation = pa.array([sum((a * n - s) ** 2 for a, s in zip(row, total.tolist(), strict=True)) for row in x.tolist()], pa.int64())
            y = (x - mean) @ project
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, size), pa.int32()), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), deviation, listed], ["vec_id", "deviation", "whitened"])

    kind = dict(vectors.dtypes)["vec_id"]
    return vectors.select("vec_id", vector).mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")


def op11_embedding_whitening(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    vectors, dim = usable(embeddings)
    fitted = fit(vectors, dim)
    if fitted is None:
        kind = dict(embeddings.dtypes)["vec_id"]
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    k = min(COMPONENTS, dim)
    kept = np.where(np.arange(k) < fitted.rank, fitted.eigenvalues[:k], 0.0)
    shares = [F.lit(float(e) / fitted.trace) if fitted.trace > 0 else F.lit(None).cast("double") for e in kept]
    rows = whiten(vectors, fitted, k=k).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "y"))
    return rows.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(fitted.n).cast("long").alias("n"),
        "deviation",
        F.nanvl("y", F.lit(None).cast("double")).alias("whitened"),
        F.array(*shares)[F.col("at")].alias("explained"),
        F.lit(fitted.identity_error).cast("double").alias("identity_error"),
    )
