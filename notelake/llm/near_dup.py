"""ProbMinHash near-duplicates: signatures of weighted shingles, bands, verification, classes.

A text's elements are its distinct runs of five words, weighted by how often they occur. Each element is a Poisson
process with its weight as rate; its arrivals, at exponential distances, go to random registers, and a register keeps
the element whose arrival is first. An element stops as soon as its next arrival is later than all registers' (early
termination). The share of registers on which two signatures agree estimates the probability Jaccard similarity, which
is the plain one where weights are alike.

A link is the exact Jaccard similarity of sets, so signatures with all weights one decide which texts meet: BANDS bands
of ROWS registers put texts that may be similar in one bucket, and at a similarity of 0.8 all bands miss in 3 of 100,000
pairs, however often lines are repeated. Texts with repeated shingles have the bands of their weighted signature
besides. Buckets are linked without listing their pairs. First every member is held against the one of its bucket that
stands in the largest buckets, as the text that others were made from does, and verified pairs unite components. Then
the texts of buckets that still hold several components meet once more by rare shingles: their shingles are counted, and
of two texts as similar as asked, in order from the rarest shingle on, the longer one has in its first fifth one that the
shorter one has in its first ninth. Pairs of different components that share such a shingle, and whose sizes and places
in the order allow the similarity, are all that can be left; a passage that many texts share stands last in their
orders and brings none of them together. Every pair is verified by the exact Jaccard similarity of the sets of shingles of
whole texts; links between components are complete for texts that share a bucket. Equal texts are one text from the
start; only their number of rows grows.

Nulls: a null text is an empty one, and texts without words are copies of each other only if equal. Null ids keep
their row (label null). A text of less than five words is one shingle. Repeated rows share their class. Texts of any
length are taken whole. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, Words, blocks, few, forget, mix, utf8, written
from .components import components

BANDS, ROWS = 20, 4
WIDTH = 5
THRESHOLD = 0.8
#: Texts in buckets whose ids may be broadcast (some 30 MB).
MOST_IDS = 1 << 20
#: So many of the most frequent shingles are broadcast with their counts (1 MB); no more can be that frequent.
HOT = 1 << 16
_STEP = U64(0x9E3779B97F4A7C15)


def weighted_shingles(buf: np.ndarray, offs: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of the distinct shingles of texts, by text and hash."""
    doc, h = Words(buf, offs).shingles(width)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """One row of registers for each text; registers of a text without elements are 0."""
    time = np.full(texts * registers, np.inf)
    held = np.zeros(texts * registers, dtype=U64)
    last = np.full(texts, np.inf)
    present = np.zeros(texts, dtype=bool)
    present[doc] = True
    last[~present] = -np.inf
    arrival, state = np.zeros(len(h)), mix(h)
    with np.errstate(over="ignore", divide="ignore"):
        while len(h):
            state = state + _STEP
            draw = mix(state)
            arrival = arrival - np.log(_uniform(draw)) / weight
            alive = arrival < last[doc]
            doc, h, weight, arrival, state, draw = doc[alive], h[alive], weight[alive], arrival[alive], state[alive], draw[alive]
            slot = doc * registers + (mix(draw + _STEP) % U64(registers)).astype(np.int64)
            np.minimum.at(time, slot, arrival)
            won = time[slot] == arrival
            held[slot[won]] = h[won]
            touched = np.unique(doc[won])
            if len(touched):
                last[touched] = time.reshape(texts, registers)[touched].max(axis=1)
    return held.reshape(texts, registers)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(signature), bands), dtype=U64)
    parts = signature.reshape(len(signature), bands, rows)
    with np.errstate(over="ignore"):
        for r in range(rows):
            out = mix(out + parts[:, :, r] + U64(r + 1))
        return mix(out + np.arange(1, bands + 1, dtype=U64))


SIGNED = "doc_id long, n_words long, digest binary, bands array<long>"


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """doc_id, words, MD5 and bands of each text; a text without words has no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            buf, offs = utf8(batch.column(2))
            for i, j in blocks(offs):
                part, at = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                doc, h, n = weighted_shingles(part, at, width)
                # where no shingle is repeated, the signature by counts is the one of the set
                keys = band_hashes(signatures(doc, h, np.ones(len(h)), j - i, bands * rows), bands, rows).view(np.int64)
                repeated = np.zeros(j - i, dtype=bool)
                repeated[doc[n > 1]] = True
                mine = repeated[doc]
                by_count = np.full_like(keys, 0)
                number = np.cumsum(repeated) - 1
                by_count[repeated] = band_hashes(signatures(number[doc[mine]], h[mine], n[mine].astype(np.float64), int(repeated.sum()), bands * rows), bands, rows).view(np.int64)
                count = np.zeros(j - i, dtype=np.int64)
                np.add.at(count, doc, n)
                held = np.repeat(np.stack([count > 0, repeated], axis=1), bands, axis=1)
                ends = np.concatenate([[0], np.cumsum(held.sum(axis=1))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([keys, by_count], axis=1)[held]))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(count), batch.column(1)[i:j], lists], names=["doc_id", "n_words", "digest", "bands"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), text.alias("text")).mapInArrow(run, SIGNED)


def _jaccard(threshold: float, width: int):
    """Verifies rows (a, b, text) sorted by a, the text of a itself first (b null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, current = np.zeros(0, dtype=U64), None
        for batch in batches:
            first, second = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            buf, offs = utf8(batch.column(2))
            out = []
            for i, j in blocks(offs):
                doc, h, _ = weighted_shingles(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], width)
                ends = np.searchsorted(doc, np.arange(j - i + 1))
                for k in range(i, j):
                    mine = h[ends[k - i] : ends[k - i + 1]]
                    if second[k] is None:
                        own, current = mine, first[k]
                    elif current == first[k] and len(mine) and len(own):
                        if min(len(mine), len(own)) < threshold * max(len(mine), len(own)):
                            continue
                        at = np.minimum(np.searchsorted(own, mine), len(own) - 1)
                        both = int((own[at] == mine).sum())
                        if both >= threshold * (len(own) + len(mine) - both):
                            out.append((first[k], second[k]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, width: int = WIDTH) -> DataFrame:
    """Of pairs (a, b), those whose texts (id, text) are similar enough. A text travels once for each pair that it is
    the second of; a first text with many pairs is dealt to several tasks with its text once in each."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(16)).cast("int"))
    heads = salted.select("a", "salt").distinct().join(texts, F.col("a") == F.col("id")).select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    tails = salted.join(texts, F.col("b") == F.col("id")).select("a", "salt", "b", "text")
    rows = heads.union(tails).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.select("a", "b", "text").mapInArrow(_jaccard(threshold, width), "a long, b long")


SHINGLED = "id long, size long, shingle long"


def _shingled(width: int):
    """Of rows (id, text), each distinct shingle with the text's number of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            buf, offs = utf8(batch.column(1))
            for i, j in blocks(offs):
                doc, h, _ = weighted_shingles(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], width)
                size = np.bincount(doc, minlength=j - i)
                columns = [ids[i:j][doc], size[doc], h.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "size", "shingle"])

    return run


def between(texts: DataFrame, labels: DataFrame, threshold: float, width: int = WIDTH) -> DataFrame:
    """Pairs (a, b) of texts (id, text) of different labels (id, label) that may be similar; no similar pair is missing."""
    rows = texts.select("id", "text").mapInArrow(_shingled(width), SHINGLED).join(labels, "id")
    rows = written(rows, "shingles")
    n = rows.count()
    counts = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), (F.min("label") < F.max("label")).alias("meets")).where("n > 1")
    counts = written(few(counts, n), "shingle-counts")
    # at most HOT shingles occur that often, so they may be broadcast; the others meet their counts by shingle
    often = F.lit(max(n // HOT, 1))
    hot, rest = F.broadcast(counts.where(F.col("n") > often)), counts.where(F.col("n") <= often)
    known = rows.join(hot, "shingle", "left")
    shared = known.where("n IS NOT NULL").unionByName(known.where("n IS NULL").drop("n", "meets").join(rest, "shingle"))
    # shingles of one text only come first in the order, then the rarest of the others
    each = Window.partitionBy("id")
    place = F.col("size") - F.count(F.lit(1)).over(each) + F.row_number().over(each.orderBy("n", "shingle")) - 1
    placed = shared.withColumn("pos", place).where("meets")
    t = F.lit(threshold)
    least = lambda share: F.col("size") - F.ceil(share * F.col("size") - 1e-9)
    placed = placed.withColumn("early", F.col("pos") <= least(2 * t / (1 + t))).where(F.col("pos") <= least(t))
    placed = written(few(placed.select("shingle", "label", "id", "size", "pos", "early", (F.col("size") - F.col("pos")).alias("left")), n), "prefixes")
    # labels meet first, so that members of one component never meet each other, and only where members' bounds allow it
    groups = placed.groupBy("shingle", "label").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.max("left").alias("left"), F.max("early").alias("early"))
    one, two = (groups.select("shingle", *[F.col(c).alias(c + k) for c in ("label", "low", "high", "left", "early")]) for k in "xy")
    sizes = lambda ax, bx, ay, by: (bx >= t * ay - 1e-9) & (by >= t * ax - 1e-9)
    enough = lambda lx, ly, sx, sy: F.least(lx, ly) >= t / (1 + t) * (sx + sy) - 1e-6  # noqa: E731  what the first shared shingle leaves
    c = F.col
    may = sizes(c("lowx"), c("highx"), c("lowy"), c("highy")) & enough(c("leftx"), c("lefty"), c("lowx"), c("lowy")) & (c("earlyx") | c("earlyy"))
    met = one.join(two.withColumnRenamed("shingle", "_s"), (c("shingle") == c("_s")) & (c("labelx") < c("labely")) & may).select("shingle", "labelx", "labely")
    side = lambda k: placed.select("shingle", *[F.col(x).alias(x + k) for x in ("label", "id", "size", "left", "early")])
    fits = sizes(c("sizex"), c("sizex"), c("sizey"), c("sizey")) & enough(c("leftx"), c("lefty"), c("sizex"), c("sizey"))
    fits &= F.when(c("sizex") < c("sizey"), c("earlyx")).when(c("sizex") > c("sizey"), c("earlyy")).otherwise(c("earlyx") & c("earlyy"))  # the shorter text meets by its first ninth
    y = side("y").withColumnsRenamed({"shingle": "_s", "labely": "_l"})
    pairs = met.join(side("x"), ["shingle", "labelx"]).join(y, (c("shingle") == c("_s")) & (c("labely") == c("_l")) & fits)
    return pairs.select(F.least("idx", "idy").alias("a"), F.greatest("idx", "idy").alias("b")).distinct()


def labelled(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(id, label) of all ids: the least id of the component, their own where no link holds them."""
    return written(few(ids.join(components(links), "id", "left").select("id", F.coalesce("label", "id").alias("label")), ids.count()), "joined")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """(doc_id, class_id, class_rows) of docs (doc_id, text): class_id is the least doc_id of the class."""
    sigs = written(signed(docs, bands, rows, width), "signed")
    n = sigs.count()
    distinct = written(few(sigs.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")), 8 * n), "distinct")  # wide rows
    keyed = distinct.where("id IS NOT NULL").select("id", F.explode(F.array_distinct("bands")).alias("bucket"))
    several = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = written(few(keyed.join(several, "bucket").select("id", "bucket", "n"), 2 * bands * n), "buckets")
    everyone = written(few(buckets.select("id").distinct(), n), "ids")
    near = F.broadcast if everyone.count() <= MOST_IDS else lambda df: df  # few enough, texts needn't move to be chosen
    source = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # a repeated id may have several texts: the one whose digest is its own counts
    owners = distinct.join(everyone, "id", "left_semi").select(F.col("id").alias("_id"), F.col("digest").alias("_digest"))
    texts = source.join(near(everyone), "id", "left_semi").join(near(owners), (F.col("id") == F.col("_id")) & (F.unhex(F.md5(F.col("text").cast("binary"))) == F.col("_digest")), "left_semi").dropDuplicates(["id"])
    texts = written(few(texts, 16 * n), "texts")  # some 4096 texts a file
    # every member of a bucket against the one of them with the most bucket mates
    mates = buckets.groupBy("id").agg(F.sum("n").alias("mates"))
    first = buckets.join(mates, "id").groupBy("bucket").agg(F.max_by("id", F.struct("mates", F.xxhash64("id"))).alias("first"))
    pairs = buckets.join(first, "bucket").where("id <> first").select(F.least("id", "first").alias("a"), F.greatest("id", "first").alias("b")).distinct()
    links = written(verified(pairs, texts, threshold, width), "links")
    labels = labelled(everyone, links)
    # what is left in buckets of several components
    held = buckets.join(labels, "id")
    several = held.groupBy("bucket").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low < _high").select("bucket")
    left = texts.join(held.join(several, "bucket").select("id").distinct(), "id", "left_semi")
    more = written(verified(between(written(left, "left"), labels, threshold, width), texts, threshold, width), "links")
    if not more.isEmpty():
        named = labels.select(F.col("id").alias("_i"), "label")
        joined = more.join(named.select(F.col("_i").alias("a"), F.col("label").alias("la")), "a").join(named.select(F.col("_i").alias("b"), F.col("label").alias("lb")), "b")
        united = components(joined.select(F.col("la").alias("a"), F.col("lb").alias("b"))).select(F.col("id").alias("label"), F.col("label").alias("_least"))
        labels = labels.join(united, "label", "left").select("id", F.coalesce("_least", "label").alias("label"))
    names = distinct.select(F.col("digest").alias("_d"), F.col("id").alias("_id"))
    labels = labels.select(F.col("id").alias("_member"), "label")
    classed = sigs.select("doc_id", "n_words", "digest").join(names, F.col("digest") == F.col("_d")).join(labels, F.col("_id") == F.col("_member"), "left")
    classed = classed.select("doc_id", "n_words", F.coalesce("label", "_id").alias("class_id"))
    sizes = classed.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_rows")).withColumnRenamed("class_id", "_class")
    return classed.join(sizes, F.col("class_id").eqNullSafe(F.col("_class"))).select("doc_id", "class_id", "class_rows", "n_words")


def op3_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near-duplicates of each document, with its number of rows."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "class_rows", F.col("n_words").alias("n_shingles"))
