"""Cross-entropy difference: how much better a target model than a background model foresees a document.

Both are word bigram models over the words of the corpus. Every distinct word and every distinct pair of neighbours is
counted on its own, so the models grow with the corpus; they are never in one place. The target is a set of documents,
the background all others; background counts are scaled to the target's total, so both models are smoothed alike. A
word's probability after another is its pair's count, with PRIOR times its own probability added, over the other's count
and PRIOR. Every document is left out of the counts that score it, so those of the target are judged as held-out ones are. A word's own probability is smoothed over all distinct words. A document's score is the mean over its words
of the target's loss less the background's, in bits: the lower, the nearer to the target.

Words and pairs are told apart by 62 bits of hash: of a billion distinct ones, about one in ten corpora has two that
meet. Documents are dealt to blocks of about BLOCK bytes, keys to parts of which each counts about PART bytes of text;
both grow in number with the corpus. A block sends each of its distinct keys, with its counts, once to the key's part,
so a frequent word or pair is no heavier there than blocks are many; the part adds up and sends the corpus's counts back
to the block, which meets its documents again and scores them. The driver sees three totals.

Nulls: a null text has no words; a document without words has null losses and score; null ids are scored and belong to
the background. Repeated rows count each; of several labels of an id, each has to be good. Without any target document
the target model is uniform. Texts are taken whole. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Words, blocks, mix, utf8, written

PRIOR = 20.0
ALPHA = 0.5
#: Bytes of text that are looked up together, and whose keys one part counts.
BLOCK, PART = 1 << 23, 1 << 24
#: The lowest bit of a key is left for the side, the next one tells words from pairs.
WORD, CLEAR = U64(2), U64(0xFFFFFFFFFFFFFFFC)
START = (U64(0x9E3779B97F4A7C15) & CLEAR) | WORD


def keys(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, key, key before (START at a document's start) and pair's key of each word; words by document."""
    out = [(np.zeros(0, dtype=np.int64), *[np.zeros(0, dtype=U64)] * 3, np.zeros(0, dtype=np.int64))]
    for i, j in blocks(offs):
        w = Words(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        own = (w.hashes() & CLEAR) | WORD
        before = np.empty_like(own)
        before[1:] = own[:-1]
        before[w.first[:-1][w.count > 0]] = START
        with np.errstate(over="ignore"):
            out.append((w.doc + i, own, before, mix(mix(before) + own) & CLEAR, w.count))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    """Parts are ranges of keys, so sorted keys are sorted by part."""
    return (((key >> U64(32)) * U64(parts)) >> U64(32)).astype(np.int64)


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """The rows of each value of the first column, by which batches are sorted."""
    held, current = [], None
    for batch in batches:
        group = batch.column(0).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i == j:
                continue
            if held and group[i] != current:
                yield current, held
                held = []
            current = int(group[i])
            held.append(batch.slice(i, j - i))
    if held:
        yield current, held


def texts(rows: list[pa.RecordBatch], ids: int, text: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Ids, bytes and offsets of the texts of a block."""
    column = pa.concat_arrays([r.column(text).cast(pa.large_string()) for r in rows])
    return pa.concat_arrays([r.column(ids) for r in rows]), *utf8(column)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers as their bytes of each order, compressed apart; orders that are zero throughout are left out."""
    width = (int(numbers.max(initial=0)).bit_length() + 7) // 8
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width])
    codec = pa.Codec("zstd", compression_level=1)
    parts = [codec.compress(p.tobytes(), asbytes=True) for p in planes]
    return np.array([len(numbers), width, *map(len, parts)], dtype="<u4").tobytes() + b"".join(parts)


def unpacked(blob: bytes) -> np.ndarray:
    n, width = (int(x) for x in np.frombuffer(blob, "<u4", 2))
    codec, at = pa.Codec("zstd", compression_level=1), 8 + 4 * width
    planes = np.zeros((8, n), dtype=np.uint8)
    for k, size in enumerate(np.frombuffer(blob, "<u4", width, 8).tolist()):
        planes[k] = np.frombuffer(codec.decompress(blob[at : at + size], n, asbytes=True), np.uint8)
        at += size
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def packed_keys(key: np.ndarray, part: int, parts: int) -> bytes:
    """Sorted keys of a part as steps from its least."""
    return packed(np.diff(key, prepend=U64(-(-(part << 32) // parts) << 32)))


def unpacked_keys(blob: bytes, part: int, parts: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(unpacked(blob), dtype=U64) + U64(-(-(part << 32) // parts) << 32)


def rows_of(names: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for x, c in zip(names.split(", "), columns, strict=True)], names=[x.split()[0] for x in names.split(", ")])


ASKED = "part long, block long, keys binary, background binary, target binary"


def _asked(parts: int):
    """Of rows (block, kind, doc_id, text) by block and kind (0: ids of the target, 1: documents), the block's counts by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in grouped(batches):
            table = pa.Table.from_batches(rows)
            kind = table.column(1).to_numpy()
            named = table.column(2).to_numpy()[kind == 0]  # targets have no null id
            ids, buf, offs = texts([r for r in table.filter(pa.array(kind == 1)).to_batches() if len(r)] or [rows[0].slice(0, 0)], 2, 3)
            target = np.isin(ids.fill_null(0).to_numpy(), named) & ids.is_valid().to_numpy(zero_copy_only=False)
            doc, own, _, pair, count = keys(buf, offs)
            side = target.astype(U64)
            every = np.concatenate([own | side[doc], pair | side[doc], START | side[count > 0]])
            every, n = np.unique(every, return_counts=True)
            if not len(every):
                continue
            key, at = np.unique(every & ~U64(1), return_inverse=True)
            both = np.zeros((2, len(key)), dtype=np.int64)
            both[(every & U64(1)).astype(np.int64), at] = n
            cuts = np.searchsorted(part_of(key, parts), np.arange(parts + 1))
            full = [(p, i, j) for p, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if i < j]
            yield rows_of(ASKED, [p for p, _, _ in full], [block] * len(full), [packed_keys(key[i:j], p, parts) for p, i, j in full], *[[packed(c[i:j]) for _, i, j in full] for c in both])

    return run


TOLD = "block long, part long, background binary, target binary, n_background long, n_target long, vocabulary long"


def _told(parts: int):
    """Of rows ASKED by part, the corpus's counts of each block's keys, and a row without block with the part's totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in grouped(batches):
            block, *blobs = ([x for r in rows for x in r.column(c).to_pylist()] for c in range(1, 5))
            asked = [unpacked_keys(b, part, parts) for b in blobs[0]]
            ends = np.cumsum([len(k) for k in asked])
            key, at = np.unique(np.concatenate(asked), return_inverse=True)
            sums = [np.bincount(at, weights=np.concatenate([unpacked(b) for b in side]), minlength=len(key)).astype(np.int64) for side in blobs[1:]]
            word = ((key & WORD) > 0) & (key != START)
            yield rows_of(TOLD, [None], [part], [None], [None], *[[int(s[word].sum())] for s in sums], [int(word.sum())])
            for k, (i, j) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)):
                yield rows_of(TOLD, [block[k]], [part], *[[packed(s[at[i:j]])] for s in sums], [None], [None], [None])

    return run


SCORED = "doc_id long, n_words long, target_loss double, background_loss double"


def _own(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How often each entry's key occurs in its document."""
    _, at, n = np.unique(doc.astype(np.int64) << 32 | key, return_inverse=True, return_counts=True)
    return n[at]


def _scored(totals: tuple[int, int, int]):
    """Of rows (block, part, background, target, doc_id, text) by block and part (-2: ids of the target, -1: documents), the
    documents' losses."""
    scale = totals[1] / totals[0] if totals[0] and totals[1] else 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches):
            table = pa.Table.from_batches(rows)
            part = table.column(1).to_numpy()
            docs = [r for r in table.filter(pa.array(part == -1)).to_batches() if len(r)]
            if not docs:
                continue  # the target names ids that there aren't
            ids, buf, offs = texts(docs, 4, 5)
            named = table.filter(pa.array(part == -2)).column(4).to_numpy()
            ours = np.isin(ids.fill_null(0).to_numpy(), named) & ids.is_valid().to_numpy(zero_copy_only=False)
            doc, own, before, pair, count = keys(buf, offs)
            key, at = np.unique(np.concatenate([own, pair, np.full(min(len(own), 1), START)]), return_inverse=True)
            told = table.filter(pa.array(part >= 0))
            n, first = len(own), before == START
            context = np.empty(n, dtype=np.int64)
            context[1:] = at[: max(n - 1, 0)]
            context[first] = at[-1] if n else 0
            own_single, own_pair = _own(doc, at[:n]), _own(doc, at[n : 2 * n])
            own_ahead = np.ones(n, dtype=np.int64)  # a document starts once
            own_ahead[1:] = own_single[: max(n - 1, 0)]
            own_ahead[first] = 1
            out = []
            for side, total, times, mine in ((2, totals[0], scale, ~ours), (3, totals[1], 1.0, ours)):
                counts, less = np.concatenate([np.zeros(0), *map(unpacked, told.column(side).to_pylist())]), mine[doc]
                single, both, ahead = ((counts[c] - less * o) * times for c, o in ((at[:n], own_single), (at[n : 2 * n], own_pair), (context, own_ahead)))
                alone = (single + ALPHA) / ((total - less * count[doc]) * times + ALPHA * totals[2])
                loss = -np.log2((both + PRIOR * alone) / (ahead + PRIOR))
                out.append(np.bincount(doc, weights=loss, minlength=len(count)) / np.maximum(count, 1))
            none = count == 0
            yield pa.RecordBatch.from_arrays([ids, pa.array(count.astype(np.int64)), pa.array(out[1], mask=none), pa.array(out[0], mask=none)], names=[x.split()[0] for x in SCORED.split(", ")])

    return run


def score(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss and score of docs (doc_id, text); target has the target's doc_ids."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    many, parts = size // BLOCK + 1, size // PART + 1
    # targets reach the blocks of their documents by their ids; rows without id are dealt by their text
    block = F.pmod(F.xxhash64("doc_id"), F.lit(many))
    flags = target.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct().select(block.alias("block"), F.lit(0).alias("kind"), "doc_id", F.lit(None).cast("string").alias("text"))
    placed = docs.select(F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(many))).otherwise(block).alias("block"), "doc_id", "text")
    rows = flags.unionByName(placed.withColumn("kind", F.lit(1))).repartition(many, "block").sortWithinPartitions("block", "kind")
    asked = rows.select("block", "kind", "doc_id", "text").mapInArrow(_asked(parts), ASKED)
    told = written(asked.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_told(parts), TOLD), "counts")
    totals = tuple(int(x or 0) for x in told.where("block IS NULL").agg(F.sum("n_background"), F.sum("n_target"), F.sum("vocabulary")).first())
    answers = told.where("block IS NOT NULL").select("block", "part", "background", "target", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    none = F.lit(None).cast("binary")
    of = lambda rows, part: rows.select("block", F.lit(part).cast("long").alias("part"), none.alias("background"), none.alias("target"), "doc_id", "text")
    both = answers.unionByName(of(placed, -1)).unionByName(of(flags, -2))
    scored = both.repartition(many, "block").sortWithinPartitions("block", "part").mapInArrow(_scored(totals), SCORED)
    return scored.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def good_documents(labels: DataFrame) -> DataFrame:
    """Ids that are labelled good and not toxic, throughout."""
    return labels.groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 AND t = 0 AND doc_id IS NOT NULL").select("doc_id")


def op9_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by how much nearer they are to the good ones than to the rest."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, good_documents(labels))
