"""Vector best-fit packing: token, document and attention-cost capacities decide together where a piece goes.

A piece of n tokens demands (n, 1, n * n) of a sequence's capacities. Pieces go from long to short; each goes to the
open sequence that fits under every constraint and whose residual vector scores best: `norm` takes the smallest
weighted norm of what would remain, `dot` the largest weighted product of demand and residual. A new sequence opens
where none fits.

Pieces of one length are alike, and sequences with one history have one residual, so the choice is made once for
each such class. By `norm` that is what choosing piece by piece gives, as a sequence that has taken a piece has less left than
its like and stays the best until it is full; by `dot`, too, sequences of a class are filled one after another. With the
default capacities tokens alone can bind, as the contract of the query knows no other limit. The driver sees a histogram of at most max_tokens rows, whatever the size of the input, and returns
runs of ranks within a length. Spark ranks the pieces within their length (in salted parts, as a third of them may have
one length) and joins them to these runs, of which there are at most a few for each length.

Nulls: a null text is empty and still has its end id; null ids stay null. Repeated rows are packed as rows of their own.
Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept, written

SALTS = 64
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_WORD = re.compile(r"[^ \t\n\r\x0b\x0c]+")
#: Letters without a composed form that differs, and signs that start no contraction or special token.
_LETTERS = "".join(chr(c) for c in range(0xC0, 0x100) if chr(c).isalpha())
_SIGNS = r"[!-&(-/:;=-@\[-`{-~]*"
_PLAIN = re.compile(f"({_SIGNS})([A-Za-z{_LETTERS}]+)({_SIGNS})")
#: Distinct words whose ids a worker remembers before it starts anew.
MEMO = 1 << 20


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds. The defaults for documents and attention are what max_tokens implies: one token a
    document, and one document that fills the sequence."""

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"


def best_fit(histogram: list[tuple[int, int]], cap: Capacity) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, end rank, pieces for each sequence, first sequence, offset) for (length, count) pairs.

    A run's piece of rank r stands in sequence first + (r - first rank) // per, behind the earlier ones of its run.
    """
    limit = np.array([cap.tokens, cap.documents, cap.attention], dtype=np.float64)
    size = 1024
    left = np.zeros((size, 3), dtype=np.int64)
    first, many = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    classes, sequences, runs = 0, 0, []

    def add(residual, start: int, count: int) -> None:
        nonlocal left, first, many, classes
        if classes == len(many):
            left, first, many = np.concatenate([left, np.zeros_like(left)]), np.concatenate([first, np.zeros_like(first)]), np.concatenate([many, np.zeros_like(many)])
        left[classes], first[classes], many[classes] = residual, start, count
        classes += 1

    for length, count in sorted(histogram, reverse=True):
        demand = np.array([length, 1, length * length], dtype=np.int64)
        if (demand > limit).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        rank = 0
        while rank < count:
            fits = np.flatnonzero((left[:classes] >= demand).all(axis=1))
            if len(fits):
                scaled, need = left[fits] / limit, demand / limit
                score = ((scaled - need) ** 2 * cap.weights).sum(axis=1) if cap.rule == "norm" else -(scaled * need * cap.weights).sum(axis=1)
                g = int(fits[np.argmin(score)])
            else:
                per = int(min(limit // demand))
                g = classes
                add(limit.astype(np.int64), sequences, -(-(count - rank) // per))
                sequences += int(many[g])
            per = int(min(left[g] // demand))
            offset, start = cap.tokens - int(left[g, 0]), int(first[g])
            full, rest = divmod(min(count - rank, per * int(many[g])), per)
            if full:
                runs.append((length, rank, rank + full * per, per, start, offset))
            if rest:
                runs.append((length, rank + full * per, rank + full * per + rest, rest, start + full, offset))
            rank += full * per + rest
            before, more = left[g].copy(), int(many[g]) - full - bool(rest)
            parts = [(before - per * demand, start, full)] * bool(full) + [(before - rest * demand, start + full, 1)] * bool(rest) + [(before, start + full + bool(rest), more)] * (more > 0)
            left[g], first[g], many[g] = parts[0]
            for part in parts[1:]:
                add(*part)
    return runs


def _probes() -> list[str]:
    """Words with every letter and sign that _PLAIN allows."""
    letters, signs = string.ascii_letters + _LETTERS, [chr(c) for c in range(33, 127) if re.fullmatch(_SIGNS, chr(c))]
    return [f"{sign}a{c}{c}{sign}{sign}" for k, c in enumerate(letters) for sign in ("", signs[k % len(signs)])] + [f"{x}the{y}" for x, y in zip(signs, signs[1:], strict=False)]


class WordIds(dict):
    """The ids of words as bytes; a word that this worker hasn't met yet is encoded when it is looked up.

    Where the tokenizer folds case and separates letters from other signs, which is tried on all of them at the start, a
    word of letters between signs is the ids of its parts, and far fewer parts than words are new. Other words, and all
    words of another tokenizer, go to it whole."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in _LETTERS}
        self.parts: dict[str, bytes] = {"": b""}
        self.separates = all(self._parts(m) == self._whole(m[0]) for m in map(_PLAIN.fullmatch, _probes()))

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _parts(self, plain: re.Match) -> bytes:
        return self.part(plain[1]) + self.part(plain[2].lower()) + self.part(plain[3])

    def part(self, text: str) -> bytes:
        if text not in self.parts:
            if len(self.parts) > MEMO:
                self.parts = {"": b""}
            self.parts[text] = np.array([t.id for t in self.model.tokenize(text.translate(self.letters))], dtype="<u4").tobytes()
        return self.parts[text]

    def __missing__(self, word: str) -> bytes:
        if len(self) > MEMO:
            self.clear()
        plain = _PLAIN.fullmatch(word) if self.separates else None
        ids = self[word] = self._parts(plain) if plain else self._whole(word)
        return ids


def word_ids(path: str) -> WordIds:
    """The words of the tokenizer at path, with those that this worker's earlier tasks met."""
    return kept(f"words of {path}", lambda: WordIds(path))


def pieces_of(docs: DataFrame, tokenizer: str, max_tokens: int, end_id: int) -> DataFrame:
    """Pieces of at most max_tokens ids of each document, without their ids.

    White space bounds what the tokenizer merges, so ids are looked up word by word; words not met before go to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = word_ids(tokenizer).__getitem__, np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = b"".join(map(ids_of, _WORD.findall(text.as_py() or ""))) + end
                for k, at in enumerate(range(0, len(ids), 4 * max_tokens)):
                    part = ids[at : at + 4 * max_tokens]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            if out:
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def pack(pieces: DataFrame, cap: Capacity) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    spark = pieces.sparkSession
    pieces = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)))
    counts = pieces.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("length").alias("_len"), F.col("_salt").alias("_s"), before.alias("_before"))  # at most tokens * SALTS rows
    histogram = [(r[0], r[1]) for r in pieces.groupBy("length").count().collect()]  # at most cap.tokens rows
    plan = spark.createDataFrame(best_fit(histogram, cap), "_length long, _from long, _to long, _per long, _first long, _offset long")
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("_rank", F.row_number().over(order) - 1)
    ranked = ranked.join(F.broadcast(starts), (F.col("length") == F.col("_len")) & (F.col("_salt") == F.col("_s"))).withColumn("_rank", F.col("_rank") + F.col("_before"))
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    at = F.col("_rank") - F.col("_from")
    return placed.select(
        *[x.split()[0] for x in PIECES.split(", ")], (F.col("_first") + F.floor(at / F.col("_per"))).cast("long").alias("sequence_id"), (F.col("_offset") + F.pmod(at, F.col("_per")) * F.col("length")).cast("long").alias("offset")
    )


def pack_documents(docs: DataFrame, tokenizer: str, cap: Capacity | None = None, end_id: int = 1) -> DataFrame:
    """One row for each piece of docs (doc_id, text) with its place."""
    cap = cap or Capacity()
    return pack(written(pieces_of(docs, tokenizer, cap.tokens, end_id), "pieces"), cap)


def op7_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
