"""Exact top-k by inner product over two cover trees, one of the queries and one of the vectors.

Rows are routed to the nearest of some pivots (a bounded sample, as a tree's upper level), each pivot's rows are cut into
parts of at most so many, and each part is a cover tree: a node has a point, the radius that covers all below it, and children
around points of its own that lie more than the half of that radius apart. Points that would be children alone share leaves
around their parent's point, with their true radii.

For nodes with points q, p and radii a, b no inner product below them exceeds <q, p> + a |p| + b |q| + a b. A pair of nodes
is pruned where that is less than the worst of the k-th scores that the queries below the first node have so far. That holds
between parts as well: every part of queries meets the part that its centre scores best, this gives each query a first k-th
score, and only the pairs of parts that can beat the worst of them meet at all. Scores are sums of integers and exact.

Nulls: a vector that is null or holds null or non-finite components takes no part; a null vec_id is no query and comes after all
others of its score. Vectors meet those of their own size only. Equal rows and repeated ids are rows of their own, and only a
query's own row is left out. Vectors whose products don't fit 64 bits are an error. Many copies of one vector are dealt to
several parts. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

#: Rows of a part of vectors and of queries, and of a leaf; pivots at most, each about a quarter of a part.
PART, ASKED_PART, LEAF, MOST_PIVOTS = 2048, 512, 32, 1024
#: Pairs of nodes whose bounds are computed together.
TOGETHER = 1 << 15

PACKED = "part string, size int, count int, centre array<long>, radius double, row array<long>, id array<long>, x binary, begin array<int>, end array<int>, point array<int>, radii array<double>, kids_from array<int>, kids_to array<int>"
FOUND = "query long, query_id long, row long, vec_id long, score long"


# ---------------------------------------------------------------- one tree


class Tree:
    """A cover tree of points x: node i covers the rows begin[i] to end[i] of order, and has children kids_from[i] to kids_to[i]."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        n = len(x)
        self.order = np.zeros(n, dtype=np.int64)
        self.begin, self.end, self.point, self.radius, self.kids_from, self.kids_to = [], [], [], [], [], []
        values = x.astype(np.float64)
        open_nodes = [self._node(values, 0, np.arange(n), 0)] if n else []
        while open_nodes:
            node, own, away = open_nodes.pop(0)
            self.order[self.begin[node] : self.end[node]] = own
            if len(own) <= leaf or self.radius[node] == 0:
                continue
            groups = self._split(values, own, away, self.radius[node] / 2, leaf)
            at, self.kids_from[node] = self.begin[node], len(self.begin)
            for centre, members in groups:
                open_nodes.append(self._node(values, centre, members, at))
                at += len(members)
            self.kids_to[node] = len(self.begin)

    def _node(self, values, centre, members, begin):
        away = np.sqrt(((values[members] - values[centre]) ** 2).sum(1))
        for name, value in (("begin", begin), ("end", begin + len(members)), ("point", centre), ("radius", float(away.max()) * (1 + 1e-12)), ("kids_from", 0), ("kids_to", 0)):
            getattr(self, name).append(value)
        return len(self.begin) - 1, members, away

    def _split(self, values, own, away, radius, leaf) -> list[tuple[int, np.ndarray]]:
        """Children's points with what they cover: the nearest to the node's point first, then points beyond all balls so far."""
        left, groups, alone, away_left = own, [], [], away
        first = True
        while len(left):
            centre = left[np.argmin(away_left)] if first else left[0]
            near = np.sqrt(((values[left] - values[centre]) ** 2).sum(1)) <= radius
            (groups if near.sum() > leaf // 8 else alone).append((centre, left[near]))
            left, away_left, first = left[~near], away_left[~near], False
        rest = np.concatenate([m for _, m in alone]) if alone else np.zeros(0, dtype=np.int64)
        rest = rest[np.argsort(values[rest] @ (values[rest].mean(0)), kind="stable")] if len(rest) else rest
        return groups + [(rest[i], rest[i : i + leaf]) for i in range(0, len(rest), leaf)]


class Part:
    """A packed tree, its rows in the tree's order."""

    def __init__(self, row: dict, prefix: str):
        column = lambda name: np.asarray(row[prefix + name])
        size = row[prefix + "size"]
        self.row = np.array(row[prefix + "row"], dtype=np.int64)
        self.none = np.array([i is None for i in row[prefix + "id"]], dtype=bool)
        self.id = np.array([0 if i is None else i for i in row[prefix + "id"]], dtype=np.int64)
        self.x = np.frombuffer(row[prefix + "x"], dtype="<i8").reshape(len(self.row), size)
        self.begin, self.end, self.point, self.radius = column("begin"), column("end"), column("point"), column("radii")
        self.kids_from, self.kids_to = column("kids_from"), column("kids_to")
        self.leaf = self.kids_to == self.kids_from
        self.centre = self.x[self.point].astype(np.float64)
        self.norm = np.sqrt((self.centre**2).sum(1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, exact."""
    most = a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most >= 1 << 63:
        raise OverflowError("inner products beyond 64 bits")
    return a @ b.T


def dual(asked: Part, held: Part, k: int, floors: dict[int, int]):
    """Places (query, vector) and scores that may be among each query's k best, floors (by row) being scores to reach."""
    lowest = np.iinfo(np.int64).min
    worst = np.array([floors.get(int(r), lowest) for r in asked.row], dtype=np.int64)
    best = np.full((len(worst), k), lowest)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def bound(a, b):
        top = (asked.centre[a] * held.centre[b]).sum(1) + asked.radius[a] * held.norm[b] + held.radius[b] * asked.norm[a] + asked.radius[a] * held.radius[b]
        return top + 1e-9 * np.abs(top) + 1e-6

    def least(a):
        """The worst k-th score below each node; a reduction can't end behind the last row, which is looked at apart."""
        ends = np.minimum(asked.end[a], len(worst) - 1)
        low = np.minimum.reduceat(worst, np.stack([asked.begin[a], ends], 1).ravel())[::2]
        return np.where(asked.end[a] == len(worst), np.minimum(low, worst[-1]), low)

    def base(a, b):
        q, p = slice(asked.begin[a], asked.end[a]), slice(held.begin[b], held.end[b])
        scores = products(asked.x[q], held.x[p])
        scores = np.where(asked.row[q][:, None] == held.row[p][None, :], lowest, scores)
        i, j = np.nonzero((scores >= worst[q][:, None]) & (scores > lowest))
        if not len(i):
            return
        found.append((i + q.start, j + p.start, scores[i, j]))
        best[q] = np.partition(np.concatenate([best[q], scores], axis=1), scores.shape[1], axis=1)[:, -k:]
        worst[q] = np.maximum(worst[q], best[q].min(1))

    stack = [(np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))] if len(worst) and len(held.row) else []
    while stack:
        a, b = stack.pop()
        top = bound(a, b)
        stay = top >= least(a)
        a, b, top = a[stay], b[stay], top[stay]
        ends = asked.leaf[a] & held.leaf[b]
        for i in np.flatnonzero(ends)[np.argsort(-top[ends], kind="stable")]:
            if top[i] >= worst[asked.begin[a[i]] : asked.end[a[i]]].min():
                base(a[i], b[i])
        a, b, top = a[~ends], b[~ends], top[~ends]
        if not len(a):
            continue
        # of each pair the node with the larger radius is opened; pairs with the greatest bounds come first
        by_q = ~asked.leaf[a] & (held.leaf[b] | (asked.radius[a] >= held.radius[b]))
        opened, tree = np.where(by_q, a, b), (asked, held)
        begin, end = (np.where(by_q, getattr(tree[0], x)[np.where(by_q, a, 0)], getattr(tree[1], x)[np.where(by_q, 0, b)]) for x in ("kids_from", "kids_to"))
        n = end - begin
        of = np.repeat(np.arange(len(opened)), n)
        kid = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begin[of]
        na, nb = np.where(by_q[of], kid, a[of]), np.where(by_q[of], b[of], kid)
        order = np.argsort(bound(na, nb), kind="stable")
        for i in range(0, len(order), TOGETHER):
            stack.append((na[order[i : i + TOGETHER]], nb[order[i : i + TOGETHER]]))
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 3
    q, p, s = (np.concatenate(x) for x in zip(*found, strict=True))
    good = s >= worst[q]
    q, p, s = q[good], p[good], s[good]
    order = np.lexsort((held.row[p], held.id[p], held.none[p], -s, q))
    q, p, s = q[order], p[order], s[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], p[place < k], s[place < k]


# ---------------------------------------------------------------- parts of a table


def points(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, x, size) of vectors (vec_id, embedding) that hold finite numbers only; x is floor(1024 c) of each c."""
    entries = F.transform("embedding", lambda c: c.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), entries.alias("e")).where("e IS NOT NULL")
    fine = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = rows.where(fine).select("vec_id", F.transform("e", lambda c: F.floor(c * 1024)).alias("x"), F.size("e").alias("size"))
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "points")


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _routed(pivots: dict[int, np.ndarray]):
    """row, size and the number of the nearest pivot of the vector's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, near = batch.column(1).to_numpy(), np.zeros(batch.num_rows, dtype=np.int64)
            for size in np.unique(sizes):
                if size in pivots and size:
                    at, p = np.flatnonzero(sizes == size), pivots[size].astype(np.float64)
                    for i in range(0, len(at), 4096):
                        x = _matrix(batch.column(2).take(pa.array(at[i : i + 4096])), size).astype(np.float64)
                        near[at[i : i + 4096]] = np.argmin((p**2).sum(1)[None, :] - 2 * x @ p.T, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(near)], names=["row", "size", "x", "vec_id", "pivot"])

    return run


def _packed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    part, size = key[0].as_py(), table.column("size")[0].as_py()
    x = _matrix(table.column("x").combine_chunks(), size) if size else np.zeros((table.num_rows, 0), dtype=np.int64)
    tree = Tree(x)
    take = pa.array(tree.order)
    places = np.argsort(tree.order)[np.array(tree.point)]
    one = lambda values, kind: pa.array([values], kind)
    numbers, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    columns = [
        pa.array([part]), pa.array([size], pa.int32()), pa.array([table.num_rows], pa.int32()), one(x[tree.point[0]].tolist(), numbers), pa.array([tree.radius[0]]), one(table.column("row").take(take).to_pylist(), numbers),
        one(table.column("vec_id").take(take).to_pylist(), numbers), pa.array([x[tree.order].astype("<i8").tobytes()], pa.binary()), one(tree.begin, ints), one(tree.end, ints), one(places.tolist(), ints), one(tree.radius, pa.list_(pa.float64())),
        one(tree.kids_from, ints), one(tree.kids_to, ints),
    ]
    return pa.Table.from_arrays(columns, names=[c.split()[0] for c in PACKED.split(", ")])


def packed(rows: DataFrame, most: int) -> DataFrame:
    """Parts of points as trees, a row for each; a pivot's rows are dealt to as many parts as keep each at about most rows."""
    n = rows.count()
    chosen = rows.orderBy(F.xxhash64("row")).select("size", "x").limit(min(MOST_PIVOTS, 4 * n // most + 1)).collect()
    pivots: dict[int, list] = {}
    for r in chosen:
        pivots.setdefault(r["size"], []).append(r.x)
    routed = rows.select("row", "size", "x", "vec_id").mapInArrow(_routed({s: np.array(v, dtype=np.int64) for s, v in pivots.items()}), "row long, size int, x array<long>, vec_id long, pivot long")
    routed = written(routed, "routed")
    counts = routed.groupBy("size", "pivot").agg(F.count(F.lit(1)).alias("n")).withColumnsRenamed({"size": "_s", "pivot": "_p"})
    dealt = routed.join(counts, (F.col("size") == F.col("_s")) & (F.col("pivot") == F.col("_p")))
    salt = F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / F.lit(most)))
    dealt = dealt.select(F.concat_ws("/", "size", "pivot", salt).alias("part"), "row", "size", "x", "vec_id")
    return written(dealt.groupBy("part").applyInArrow(_packed, PACKED), "trees")


def _summary(parts: DataFrame, prefix: str) -> DataFrame:
    return parts.select("size", *[F.col(c).alias(f"{prefix}_{c}") for c in ("part", "count", "centre", "radius")])


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def bounds(asked: DataFrame, held: DataFrame) -> DataFrame:
    """(q_part, h_part, likeness, bound) of parts of one size, by their roots; as many rows as parts times parts of queries.

    Roots only meet here, salted, so that one size of vectors isn't one task."""
    salts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q = _summary(asked, "q").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    h = _summary(held, "h").withColumn("salt", F.pmod(F.xxhash64("h_part"), F.lit(salts)).cast("int"))
    c = F.col
    norm = lambda x: F.sqrt(_dot(c(x), c(x)))
    both = q.join(h, ["size", "salt"]).withColumn("likeness", _dot(c("q_centre"), c("h_centre")))
    top = c("likeness") + c("q_radius") * norm("h_centre") + c("h_radius") * norm("q_centre") + c("q_radius") * c("h_radius")
    return both.select("q_part", "h_part", "h_count", "likeness", (top + F.abs(top) * 1e-9 + 1e-6).alias("bound"))


def _dual(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                asked, held = Part(row, "q_"), Part(row, "h_")
                floors = {f["query"]: f["low"] for f in row["floors"] or []}
                q, p, s = dual(asked, held, k, floors)
                columns = [asked.row[q], asked.id[q], held.row[p], pa.array(held.id[p], mask=held.none[p]), s]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=[c.split()[0] for c in FOUND.split(", ")])

    return run


def met(pairs: DataFrame, asked: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """FOUND of pairs (q_part, h_part, floors): a pair is a row with both trees."""
    side = lambda df, prefix: df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in df.columns])
    rows = pairs.join(side(asked, "q"), "q_part").join(side(held, "h"), "h_part")
    return rows.drop("q_centre", "h_centre", "q_part", "h_part").mapInArrow(_dual(k), FOUND)


def top_k(vectors: DataFrame, wanted: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k greatest inner products of each row that wanted chooses with all other rows."""
    rows = points(vectors)
    asked, held = packed(rows.where(wanted), ASKED_PART), packed(rows, PART)
    roots = written(bounds(asked, held), "roots")
    best = roots.groupBy("q_part").agg(F.max_by("h_part", F.struct(F.col("h_count") > k, "likeness", "h_part")).alias("h_part"))
    none = F.lit(None).cast("array<struct<query:long,low:long>>")
    first = written(met(best.withColumn("floors", none), asked, held, k), "first")
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row"))
    kth = first.withColumn("_r", place("query")).where(F.col("_r") == k).select("query", F.col("score").alias("low"))
    members = asked.select(F.col("part").alias("q_part"), "count", F.explode("row").alias("query"))
    known = members.join(kth, "query").groupBy("q_part", "count").agg(F.collect_list(F.struct("query", "low")).alias("floors"), F.min("low").alias("least"))  # a part of queries
    rest = roots.join(best.select("q_part", F.col("h_part").alias("_first")), "q_part").where("h_part <> _first").join(known, "q_part", "left")
    rest = rest.where(F.col("floors").isNull() | (F.size("floors") < F.col("count")) | (F.col("bound") >= F.col("least"))).select("q_part", "h_part", "floors")
    found = first.unionByName(met(rest, asked, held, k)).withColumn("rank", place("query"))
    return found.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_dual_cover_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best other vectors of each vector whose id is divisible by 100."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH fine AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)
SELECT q.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_sum(list_transform(list_zip(q.x, p.x), lambda z: z[1] * z[2])) DESC, p.vec_id) AS INT) AS rank, p.vec_id,
  CAST(list_sum(list_transform(list_zip(q.x, p.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
FROM fine q JOIN fine p ON p.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0 QUALIFY rank <= 10"""
