"""A stored index of vectors: lists around centres, exact products inside, and bounds that make a search exact.

Centres are fitted on a bounded sample (SAMPLE vectors, by a hash of their ids), for each size of vectors apart; every vector is
in the list of its nearest centre, and a list is rows of at most PACK vectors with their greatest distance from the centre, so
that a list of any length is spread over many tasks. A vector x of a list with centre c and radius r has <q, x> <= <q, c> + |q| r.

A search by probes reads, for each query, the lists whose centres are the most similar; their number is set when centres are
fitted, so that RECALL of the ten nearest of sample queries are met. An exact search goes on from there: it reads every other
list whose bound reaches the query's k-th similarity so far, so that no neighbour is missed. Queries meet lists by join, packed,
so there may be any number of both.

Vectors that are null or hold null or non-finite numbers are in no list; those of another size than the query's meet nothing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vectors that centres are fitted on, lists at most, rounds of fitting, vectors of a row, queries of a row.
SAMPLE, MOST_LISTS, ROUNDS, PACK, ASKED = 1 << 14, 1 << 12, 8, 512, 256
#: Queries whose nearest so far a task remembers.
REMEMBERED = 1 << 16
#: Share of the ten nearest of sample queries that probes have to meet.
RECALL = 0.95

#: To be raised when what is stored changes.
FORMAT = 2
LISTS = "size int, list int, radius double, ids array<long>, x binary"
CENTRES = "size int, list int, probes int, centre array<double>"
FOUND = "query_id long, note_id long, similarity double"


def _usable(vectors: DataFrame) -> DataFrame:
    """(note_id, embedding of doubles, size) of the vectors that can be compared."""
    rows = vectors.select(F.col("note_id").cast("long").alias("note_id"), F.transform("embedding", lambda c: c.cast("double")).alias("embedding"))
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return rows.where(F.col("note_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(fine).withColumn("size", F.size("embedding"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def fitted(x: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres by Lloyd's steps from evenly spaced rows of x; a centre that loses all its rows stays where it is."""
    centres = x[np.linspace(0, len(x) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        n = np.bincount(near, minlength=lists)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), dtype=np.int64)
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = np.argmin((centres**2).sum(1)[None, :] - 2 * x[i : i + 4096] @ centres.T, axis=1)
    return out


def probes_for(x: np.ndarray, centres: np.ndarray, recall: float = RECALL, queries: int = 256, k: int = 10) -> int:
    """How many lists have to be read for a share of recall of the k nearest of sample queries within the sample."""
    chosen = np.linspace(0, len(x) - 1, min(queries, len(x))).astype(int)
    likeness = x[chosen] @ x.T
    likeness[np.arange(len(chosen)), chosen] = -np.inf
    best = np.argsort(-likeness, axis=1)[:, : min(k, len(x) - 1)]
    place = np.argsort(np.argsort(-(x[chosen] @ centres.T), axis=1), axis=1)
    needed = np.sort(place[np.arange(len(chosen))[:, None], nearest(x, centres)[best]].ravel())
    return int(needed[min(int(np.ceil(recall * len(needed))), len(needed)) - 1]) + 1 if len(needed) else 1


class Centres:
    """Centres of each size, as tasks need them."""

    def __init__(self, rows: list):
        self.of: dict[int, np.ndarray] = {}
        self.probes: dict[int, int] = {}
        for size in {r["size"] for r in rows}:
            own = sorted((r for r in rows if r["size"] == size), key=lambda r: r["list"])
            self.of[size], self.probes[size] = np.array([r["centre"] for r in own]), own[0]["probes"]

    def get(self, size: int) -> np.ndarray:
        """Vectors of a size that the sample hadn't are one list around zero."""
        return self.of.get(size, np.zeros((1, size)))


def _packed(centres: Centres):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids = batch.column(2).to_numpy(), batch.column(0).to_numpy()
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x, own = _matrix(batch.column(1).take(pa.array(at)), int(size)), centres.get(int(size))
                near = nearest(x, own)
                order = np.argsort(near, kind="stable")
                for run_of in np.split(order, np.flatnonzero(np.diff(near[order])) + 1):
                    for i in range(0, len(run_of), PACK):
                        part = run_of[i : i + PACK]
                        place = int(near[part[0]])
                        radius = float(np.sqrt(((x[part] - own[place]) ** 2).sum(1)).max())
                        yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([place], pa.int32()), pa.array([radius]), pa.array([ids[at[part]].tolist()], pa.list_(pa.int64())), pa.array([x[part].astype("<f8").tobytes()], pa.binary())], names=["size", "list", "radius", "ids", "x"])

    return run


def _routed(centres: Centres, radii: dict[tuple[int, int], float], probes: int | None, exact: bool):
    """Rows of a list's number for packed queries (size, query_id, embedding, floor): the lists that each has to read.

    exact: those that probes leave and whose bound reaches the floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(0).to_numpy()
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                own = centres.get(int(size))
                held = np.array([i for i in range(len(own)) if (int(size), i) in radii], dtype=np.int64)
                if not len(held):
                    continue
                radius = np.array([radii[int(size), int(i)] for i in held])
                few = min(probes or centres.probes.get(int(size), 1), len(held))
                for i in range(0, len(at), ASKED):
                    part = at[i : i + ASKED]
                    rows = batch.take(pa.array(part))
                    q = _matrix(rows.column(2), int(size))
                    near = q @ own[held].T
                    probed = np.zeros(near.shape, dtype=bool)
                    np.put_along_axis(probed, np.argpartition(-near, few - 1, axis=1)[:, :few], True, axis=1)
                    if exact:
                        floor = rows.column(3).to_numpy()
                        bound = near + np.sqrt((q**2).sum(1))[:, None] * radius[None, :]
                        probed = ~probed & (bound * (1 + 1e-9 * np.sign(bound)) + 1e-9 >= floor[:, None])
                    # the queries of a list, together
                    for place in np.flatnonzero(probed.any(0)):
                        mine = np.flatnonzero(probed[:, place])
                        columns = [pa.array([size], pa.int32()), pa.array([int(held[place])], pa.int32()), pa.array([rows.column(1).to_numpy()[mine].tolist()], pa.list_(pa.int64())), pa.array([q[mine].astype("<f8").tobytes()], pa.binary()), pa.array([rows.column(3).to_numpy()[mine].tolist()], pa.list_(pa.float64()))]
                        yield pa.RecordBatch.from_arrays(columns, names=["size", "list", "queries", "q", "floors"])

    return run


def products(ids: np.ndarray, x: np.ndarray, queries: np.ndarray, q: np.ndarray, floors: np.ndarray, k: int | None, itself: bool = False):
    """(query, note, similarity) of one list's rows: those that reach the floor, and of them the k nearest with their ties.

    Sums run in one order of terms, so that equal vectors are equally near."""
    about = x @ q.T
    if not itself:
        about[ids[:, None] == queries[None, :]] = -np.inf
    least = floors.copy()
    if k is not None and k < len(ids):
        least = np.maximum(least, np.partition(about, len(ids) - k, axis=0)[len(ids) - k])
    n, m = np.nonzero((about >= least - 1e-9) & (about > -np.inf))
    exact = np.zeros(len(n))
    for d in range(q.shape[1]):
        exact += x[n, d] * q[m, d]
    good = exact >= floors[m]
    return queries[m][good], ids[n][good], exact[good]


def _met(k: int | None, itself: bool):
    """FOUND of packed queries and the rows of the lists that they read; what k nearer ones of the same task leave behind isn't passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}  # each query's k greatest similarities so far, once it has as many
        for batch in batches:
            for r in batch.to_pylist():
                x, q = (np.frombuffer(r[c], dtype="<f8").reshape(-1, r["size"]) for c in ("x", "q"))
                floors = np.array(r["floors"])
                if k is not None:
                    floors = np.maximum(floors, [-np.inf if (own := best.get(i)) is None or len(own) < k else own[0] for i in r["queries"]])
                found = products(np.array(r["ids"]), x, np.array(r["queries"]), q, floors, k, itself)
                if k is not None and len(found[0]):
                    if len(best) > REMEMBERED:
                        best.clear()  # more are passed on then
                    order = np.argsort(found[0], kind="stable")
                    begins = np.flatnonzero(np.diff(found[0][order], prepend=found[0][order[0]] - 1))
                    for i, new in zip(found[0][order[begins]].tolist(), np.split(found[2][order], begins[1:]), strict=True):
                        best[i] = np.sort(np.concatenate([best[i], new]) if i in best else new)[-k:]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "note_id", "similarity"])

    return run


class VectorIndex:
    """The index at a path of the shared folder; built from vectors (note_id, embedding) where it isn't there yet."""

    def __init__(self, spark: SparkSession, path: str, vectors: DataFrame | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.centres = self._read_centres()
        if self.centres is None:
            if vectors is None:
                raise ValueError(f"no index of vectors at {path}")
            self._fit(_usable(vectors))
            self.add(vectors)
            self.spark.createDataFrame([(True,)], "done boolean").coalesce(1).write.parquet(f"{self.path}/built")
        lists = self.lists.groupBy("size", "list").agg(F.max("radius").alias("radius")).collect()  # at most MOST_LISTS for each size that the sample has
        self.radii = {(r["size"], r["list"]): r["radius"] for r in lists}

    def _read_centres(self) -> Centres | None:
        try:
            self.spark.read.schema("done boolean").parquet(f"{self.path}/built").first()
            _ = self.lists  # a path that was cleared is an error here
            return Centres(self.spark.read.schema(CENTRES).parquet(f"{self.path}/centres").collect())
        except AnalysisException:
            return None

    @property
    def lists(self) -> DataFrame:
        return self.spark.read.schema(LISTS).parquet(f"{self.path}/lists")

    def _fit(self, rows: DataFrame) -> None:
        n = rows.count()
        sample = rows.orderBy(F.xxhash64("note_id"), "note_id").limit(SAMPLE).select("size", "embedding").collect()
        out = []
        for size in sorted({r["size"] for r in sample}):
            x = np.array([r["embedding"] for r in sample if r["size"] == size])
            centres = fitted(x, max(1, min(int(np.sqrt(n * len(x) / len(sample))), len(x) // 8, MOST_LISTS)))
            probes = probes_for(x, centres)
            out += [(size, i, probes, c.tolist()) for i, c in enumerate(centres)]
        self.spark.createDataFrame(out, CENTRES).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centres")
        self.centres = Centres([dict(zip(("size", "list", "probes", "centre"), r, strict=True)) for r in out])

    def add(self, vectors: DataFrame) -> None:
        """Puts further vectors into the lists of their nearest centres; vectors of one pivot that arrive together share rows."""
        _usable(vectors).select("note_id", "embedding", "size").mapInArrow(_packed(self.centres), LISTS).write.mode("append").parquet(f"{self.path}/lists")
        if hasattr(self, "radii"):
            self.radii = {(r["size"], r["list"]): r["radius"] for r in self.lists.groupBy("size", "list").agg(F.max("radius").alias("radius")).collect()}

    def probed(self, queries: DataFrame, k: int | None, threshold: float = -np.inf, probes: int | None = None, itself: bool = False) -> DataFrame:
        """FOUND of the lists that probes choose for queries (query_id, embedding): approximate, in any order."""
        asked = _usable(queries.select(F.col("query_id").alias("note_id"), "embedding")).select("size", F.col("note_id").alias("query_id"), "embedding", F.lit(float(threshold)).alias("floor"))
        return self._meet(asked, k, probes, False, itself)

    def _meet(self, asked: DataFrame, k: int | None, probes: int | None, exact: bool, itself: bool) -> DataFrame:
        routed = asked.mapInArrow(_routed(self.centres, self.radii, probes, exact), "size int, list int, queries array<long>, q binary, floors array<double>")
        return self.lists.select("size", "list", "ids", "x").join(routed, ["size", "list"]).mapInArrow(_met(k, itself), FOUND)

    def nearest(self, queries: DataFrame, k: int | None, threshold: float = -np.inf, probes: int | None = None, exact: bool = True, itself: bool = False) -> DataFrame:
        """(query_id, note_id, similarity, rank) of the k nearest (all, where k is None) of queries (query_id, embedding), each but itself.

        itself: queries are no notes, so that a note of a query's number may be found as any other.
        exact: the result is that of all products; otherwise that of the probed lists."""
        found = self.probed(queries, k, threshold, probes, itself)
        if exact:
            floor = F.lit(float(threshold))
            asked = _usable(queries.select(F.col("query_id").alias("note_id"), "embedding")).withColumnRenamed("note_id", "query_id")
            if k is None:
                asked = asked.withColumn("floor", floor)
            else:
                kth = ranked(found, k).where(F.col("rank") == k).select(F.col("query_id").alias("_q"), F.col("similarity").alias("_low"))
                asked = asked.join(kth, F.col("query_id") == F.col("_q"), "left").withColumn("floor", F.greatest(F.coalesce("_low", floor), floor))
            found = found.unionByName(self._meet(asked.select("size", "query_id", "embedding", "floor"), k, probes, True, itself))
        return ranked(found, k)


def ranked(found: DataFrame, k: int | None) -> DataFrame:
    rows = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "note_id")))
    return rows if k is None else rows.where(F.col("rank") <= k)
