"""Vector similarity by exact products, in double precision."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .neighbours import products, ranked

#: Queries whose vectors are sent to all executors at once; more of them are served in as many passes.
BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    """Sum of products, up to the shorter one's end."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """v at length one; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def off_unit(vectors: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """(note_id, norm) of the vectors whose length isn't one; none should be left."""
    return vectors.select("note_id", F.sqrt(dot(F.col("embedding"), F.col("embedding"))).alias("norm")).where(F.abs(F.col("norm") - 1) > tolerance)


def _rows(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the vectors of one size; others, null ones too, meet nothing."""
    column = column.cast(pa.list_(pa.float64()))
    lengths = np.array(column.value_lengths().fill_null(-1))
    kept = np.flatnonzero(lengths == size)
    flat = column.take(pa.array(kept)).flatten()
    return kept, flat.to_numpy(zero_copy_only=False).reshape(len(kept), size)


def _near(ids: np.ndarray, queries: np.ndarray, k: int | None, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_numpy()
            for i in range(0, len(names), 4096):
                kept, values = _rows(batch.column(1).slice(i, 4096), queries.shape[1])
                if not len(kept):
                    continue
                found = products(names[i:][kept], values, ids, queries, np.full(len(ids), threshold), k)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "note_id", "similarity"])

    return run


def similar(vectors: DataFrame, queries: DataFrame, k: int | None, threshold: float = -2.0) -> DataFrame:
    """(query_id, note_id, similarity, rank): the k nearest (all, where k is None) of each of a stated set of queries, itself left out.

    Queries go to the executors in blocks of BLOCK, and all vectors pass each block; of a batch of vectors only the k
    nearest of each query are passed on. Vectors meet queries of their own size. operators/neighbours.py has an index for
    many queries of the same vectors; this is for vectors that a filter has just chosen."""
    queries = queries.select(F.col("note_id").cast("long").alias("note_id"), "embedding").where("note_id IS NOT NULL AND embedding IS NOT NULL")
    schema = "query_id long, note_id long, similarity double"
    sizes = queries.groupBy(F.size("embedding").alias("size")).count().orderBy("size").collect()  # the models' sizes
    parts = []
    for size, n in sizes:
        blocks = -(-n // BLOCK)
        for b in range(blocks):
            block = queries.where((F.pmod(F.xxhash64("note_id"), F.lit(blocks)) == b) & (F.size("embedding") == size)).toArrow()  # some BLOCK rows
            ids = block.column("note_id").to_numpy()
            matrix = _rows(block.column("embedding").combine_chunks(), size)[1] if len(ids) else np.zeros((0, size))
            parts.append(vectors.select(F.col("note_id").cast("long"), "embedding").where("note_id IS NOT NULL").mapInArrow(_near(ids, matrix, k, threshold), schema))
    scored = reduce(DataFrame.union, parts) if parts else queries.sparkSession.createDataFrame([], schema)
    return ranked(scored, k)


def suggestions(vectors: DataFrame, queries: DataFrame, notes: DataFrame, most: int = 5, threshold: float = 0.7) -> DataFrame:
    """(query_id, note_id, title, similarity, rank) of the nearest live notes beyond threshold; similarity to three places."""
    near = similar(vectors, queries, most, threshold)
    return near.join(notes.select("note_id", "title"), "note_id").select("query_id", "note_id", "title", F.round("similarity", 3).alias("similarity"), "rank")


def auto_edges(near: DataFrame, edges: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Edges to append for near (query_id, note_id, similarity): references from the query, but for those that exist."""
    new = near.where(F.col("similarity") >= threshold).select(F.col("query_id").alias("src"), F.col("note_id").alias("dst"), F.lit("references").alias("edge_type"))
    new = new.join(edges.select("src", "dst", "edge_type"), ["src", "dst", "edge_type"], "left_anti")
    return new.select("src", "dst", "edge_type", F.lit(1.0).alias("weight"), F.lit("auto").alias("source_type"), F.lit(None).cast("string").alias("context"))


# ---------------------------------------------------------------- vectors as bytes


def to_blobs(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vectors with column as bytes, four for each number, least significant first; null stays null, and a null number is NaN."""

    def blob(x: list | None) -> bytes | None:
        return None if x is None else np.array([math.nan if v is None else v for v in x], dtype="<f4").tobytes()

    return _converted(vectors, column, "binary", lambda cells: pa.array([blob(x) for x in cells], pa.binary()))


def from_blobs(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vectors with column as numbers again; bytes that are no whole number of fours are an error."""

    def numbers(x: bytes | None) -> np.ndarray | None:
        if x is not None and len(x) % 4:
            raise ValueError(f"{len(x)} bytes are no vector")
        return None if x is None else np.frombuffer(x, dtype="<f4")

    return _converted(vectors, column, "array<float>", lambda cells: pa.array([numbers(x) for x in cells], pa.list_(pa.float32())))


def _converted(rows: DataFrame, column: str, kind: str, of) -> DataFrame:
    at, names = rows.columns.index(column), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [*batch.columns]
            columns[at] = of(columns[at].to_pylist())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, ", ".join(f"`{n}` {kind if n == column else t}" for n, t in rows.dtypes))
