"""What the operators of this package share: tables in the shared folder and words of Arrow batches."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..plans.tables import shared_folder

#: Bytes of text that a Python worker looks at together; one longer text is still taken whole.
BLOCK_BYTES = 1 << 19


#: Rows of a table of few columns that one task writes; a table of less has FEWEST files at most.
ROWS_A_FILE, FEWEST = 1 << 16, 8


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str = "table", plain: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: lineage ends there and lost executors cost nothing.

    plain: not compressed, for small tables that are read often, as compressors hold memory outside the heap."""
    spark = df.sparkSession
    path = new_path(spark, what)
    schema = df.schema
    (df.write.option("compression", "none") if plain else df.write).parquet(path)
    return spark.read.schema(schema).parquet(path)


def few(df: DataFrame, rows: int) -> DataFrame:
    """df, which has no more than rows, in fewer partitions if it is small: behind a shuffle, for tasks with little to do.

    Each file costs a task, processes that set its rights, and a look-up when it is read."""
    return df.coalesce(max(FEWEST, rows // ROWS_A_FILE))


# ---------------------------------------------------------------- what workers remember

_KEPT: dict[str, object] = {}


def kept(what: str, make: Callable[[], object]):
    """What a worker's tasks remember from one to the next, made when the first asks."""
    if what not in _KEPT:
        forget()
        _KEPT[what] = make()
    return _KEPT[what]


def forget() -> None:
    """Lets go what tasks of another operator remember: Spark gives a worker to one operator after another."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()


# ---------------------------------------------------------------- text as arrays

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_POW: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    if not _POW or len(_POW["up"]) < n:
        size = max(n, BLOCK_BYTES + 4096)
        inverse = U64(pow(int(_BASE), -1, 1 << 64))
        _POW["up"], _POW["down"] = _powers(size, _BASE), _powers(size, inverse)
    return _POW["up"], _POW["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit changes about half of the output bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Sums over prefixes from which range_hash takes the hash of any byte range."""
    up, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, dtype=U64)
    with np.errstate(over="ignore"):
        np.cumsum((buf.astype(U64) + U64(1)) * up[: len(buf)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of bytes, the same wherever equal bytes stand."""
    _, down = powers(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; a null text is empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


def blocks(offs: np.ndarray, most: int = BLOCK_BYTES):
    """Ranges of rows of about as many bytes; each row is in one of them."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of texts that stand one after another in buf."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.buf, self.offs, n = buf, offs, len(buf)
        space = SPACE[buf]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offs] = True
        before = np.ones(n, dtype=bool)
        before[1:] = space[:-1]
        after = np.ones(n, dtype=bool)
        after[:-1] = space[1:]
        self.space = space
        self.start = np.flatnonzero(~space & (before | edge[:-1]))
        self.end = np.flatnonzero(~space & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offs)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offs) - 1), self.count)
        self.prefix = prefix_hash(buf)

    def hashes(self) -> np.ndarray:
        return range_hash(self.prefix, self.start, self.end)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For each run of width words in one text: its first word's number and its hash."""
        h = self.hashes()
        n = len(h) - width + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64)
        out = np.zeros(n, dtype=U64)
        with np.errstate(over="ignore"):
            for j in range(width):
                out = mix(out + h[j : j + n] + U64(j + 1))
        at = np.flatnonzero(self.doc[:n] == self.doc[width - 1 :])
        return at, out[at]

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Text number and hash of each shingle; a shorter text with a word is one shingle."""
        at, h = self.windows(width)
        doc = self.doc[at]
        short = np.flatnonzero((self.count > 0) & (self.count < width))
        if len(short):
            own = self.hashes()
            with np.errstate(over="ignore"):
                keys = [mix(np.bitwise_xor.reduce(mix(own[a:b] * U64(2) + np.arange(1, b - a + 1, dtype=U64))) + U64(b - a)) for a, b in zip(self.first[short], self.first[short + 1], strict=True)]
            doc, h = np.concatenate([doc, short]), np.concatenate([h, np.array(keys, dtype=U64)])
        return doc, h
