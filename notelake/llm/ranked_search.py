"""Ranked lexical search without random access (NRA): lists in order of impact, score intervals, exact ends.

Documents stand in blocks of some thousand. The index has a row for each term of a block: the block's documents that hold
the term, by falling share of a full occurrence (equal ones by place), the first HEAD of them apart from the others, so that
a reader of heads leaves the rest unread. Two rounds answer a batch of queries:

1. Each block reads the heads of the asked terms. What it has seen of a document is the least that it can score; the k-th
   greatest of these over all blocks is a floor that no result of a query lies below.
2. Each block reads its lists on, all of a query's lists to the same depth. A document's score is at least the sum of what was
   read of it and at most that plus, for each list that it wasn't met in, the list's next unread impact. Documents whose
   interval ends below the floor, or below the block's own k-th least score, are out. Reading ends when the intervals of all
   others are single values: members, ties and scores are settled then, and not before.

Blocks are dealt anew by their number, whole and of limited size; a common word has a list in each block and no task has
all of it. Queries are served in passes of limited number and size, each of which goes to all blocks.

Nulls: a null text has no term and never ranks; a null doc_id ranks after all others of its score. Repeated ids and equal
rows rank as rows of their own. Items of null id are an item as well; items without terms find nothing. Equal scores are
ordered by doc_id. Texts are read whole. Empty tables give no rows; columns besides those named are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

#: Documents and bytes of text of a block; one longer text is a block of its own.
BLOCK_ROWS, BLOCK_BYTES = 4096, 1 << 23
#: Entries of a list that are read first, and how much deeper each further reading goes.
HEAD, DEEPER = 64, 2
#: Queries of a pass, and the bytes of their texts.
PASS_ROWS, PASS_BYTES = 2048, 1 << 23

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
INDEX = "block long, term string, df long, head_docs array<int>, head_shares array<int>, more_docs array<int>, more_shares array<int>"
ASKED_TERMS = "\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F"


def terms(text: bytes | None) -> list[bytes]:
    return TERM.findall(text.translate(LOWER)) if text else []


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of texts with a term, and of all their terms."""
    some = every = 0
    for batch in batches:
        for text in batch.column(0).cast(pa.binary()):
            n = sum(1 for _ in TERM.finditer(x)) if (x := text.as_py()) else 0
            some, every = some + (n > 0), every + n
    yield pa.RecordBatch.from_arrays([pa.array([some]), pa.array([every])], names=["n", "l"])


def totals(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms of all documents."""
    row = docs.select(F.col("text").cast("string")).mapInArrow(_counted, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return int(row[0] or 0), int(row[1] or 0)


def _lists(names: list[bytes], ends: list[int], tfs: list[int], n: int, length: int):
    """The columns df, head_docs, ... and terms of one block: ends are where each document's terms end in names and tfs."""
    per = np.diff(np.concatenate([[0], ends]))
    doc, tf = np.repeat(np.arange(len(per)), per), np.array(tfs, dtype=np.int64)
    number: dict[bytes, int] = {}
    term = np.fromiter((number.setdefault(t, len(number)) for t in names), dtype=np.int64, count=len(names))
    size = np.bincount(doc, weights=tf, minlength=len(per)).astype(np.int64)  # exact below 2**53
    share = 1_000_000_000 * tf // (1000 * tf + 8 * (10 + 90 * size * n // max(length, 1))[doc])
    order = np.lexsort((doc, -share, term))
    doc, share, df = doc[order], share[order], np.bincount(term, minlength=len(number))
    begin = np.cumsum(df) - df
    first = np.arange(len(doc)) - np.repeat(begin, df) < HEAD
    lists = lambda x, sizes: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(x, pa.int32()))
    heads = np.minimum(df, HEAD)
    return [pa.array(list(number), pa.binary()).cast(pa.string()), pa.array(df), lists(doc[first], heads), lists(share[first], heads), lists(doc[~first], df - heads), lists(share[~first], df - heads)]


def _indexed(n: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        own: list = [[], [], []]  # documents, and their terms one after another with their numbers

        def rows():
            ids, names, tfs = own
            columns = _lists(names, ids_ends, tfs, n, length)
            told = len(columns[0])
            index = [pa.array(np.full(told, block)), *columns, pa.nulls(told, pa.list_(pa.int64()))]
            docs = [pa.array([block]), pa.nulls(1, pa.string()), pa.array([len(ids)]), *[pa.nulls(1, pa.list_(pa.int32()))] * 4, pa.array([ids], pa.list_(pa.int64()))]
            for parts in (index, docs):
                if len(parts[0]):
                    yield pa.RecordBatch.from_arrays(parts, names=[*(c.split()[0] for c in INDEX.split(", ")), "ids"])

        size, ids_ends = 0, []
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                text = text.as_py() or b""
                if own[0] and (len(own[0]) >= BLOCK_ROWS or size + len(text) > BLOCK_BYTES):
                    yield from rows()
                    own, size, ids_ends, block = [[], [], []], 0, [], block + 1
                counts = Counter(terms(text))
                own[0].append(doc_id.as_py())
                own[1] += counts.keys()
                own[2] += counts.values()
                ids_ends.append(len(own[1]))
                size += len(text)
        if own[0]:
            yield from rows()

    return run


class Index:
    """Lists by impact of docs (doc_id, text), written once: lists (INDEX) and documents (block, ids)."""

    def __init__(self, docs: DataFrame):
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.n, self.length = totals(docs)
        table = written(docs.mapInArrow(_indexed(self.n, self.length), f"{INDEX}, ids array<long>"), "impacts")
        self.lists = table.where("term IS NOT NULL").drop("ids")
        self.documents = table.where("term IS NULL").select("block", "ids")


def asked(queries: DataFrame) -> DataFrame:
    """(item, item_id, text, term) of queries (item_id, text): each term of each item once; item numbers the rows."""
    found = F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(f"[^{ASKED_TERMS}]+"), F.lit(0))
    return queries.select("item", F.explode(F.array_distinct(found)).alias("term"))


class _Wanted:
    """Weights and floors of a pass's queries: items by number, with the terms of each."""

    def __init__(self, rows: list, floors: dict[int, int]):
        self.items: dict[int, list[tuple[str, int]]] = {}
        for r in rows:
            self.items.setdefault(r.item, []).append((r.term, r.w))
        self.floors = floors


def _bounds(lists: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, depth: int) -> np.ndarray:
    return np.array([w * int(s[depth]) if depth < len(s) else 0 for (_, s), w in zip(lists, weights, strict=True)], dtype=np.int64)


def nra(lists: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, size: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents, of size, and scores of all that score floor or more and are among the k best, or tie with the last of them.

    lists: documents and shares of each term by falling share."""
    low, alive, depth, to = np.zeros(size, dtype=np.int64), np.arange(size), 0, HEAD
    unmet = np.ones((len(lists), size), dtype=bool)
    floor = max(floor, 1)
    while True:
        for t, ((docs, shares), w) in enumerate(zip(lists, weights, strict=True)):
            if depth < len(docs):
                low[docs[depth:to]] += w * shares[depth:to]
                unmet[t, docs[depth:to]] = False
        depth, to = to, to * DEEPER
        bounds = _bounds(lists, weights, depth)
        known = low[alive]
        high = known + bounds @ unmet[:, alive]
        if len(alive) >= k:
            floor = max(floor, int(np.partition(known, len(known) - k)[len(known) - k]))
        stay = high >= floor
        alive = alive[stay]
        if (high[stay] == known[stay]).all():
            return alive, low[alive]


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The ids and the lists of each block, of rows in order of block, its ids first."""
    block, ids, lists = None, None, {}
    for batch in batches:
        columns = [batch.column(i) for i in range(batch.num_columns)]
        for i, (at, term) in enumerate(zip(columns[0].to_pylist(), columns[1].to_pylist(), strict=True)):
            if at != block:
                if block is not None:
                    yield block, ids, lists
                block, ids, lists = at, [], {}
            value = lambda c: columns[c][i].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
            if term is None:
                ids = columns[2][i].as_py()
            else:
                parts = [value(c) for c in range(3, len(columns))]
                lists[term] = tuple(np.concatenate(parts[x::2]) if len(parts) > 2 else parts[x] for x in (0, 1))
    if block is not None:
        yield block, ids, lists


def _heads(wanted, k: int):
    """The k best of what heads show of each query's documents, as (item, low)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, lists in _by_block(batches):
            items, lows = [], []
            for item, words in wanted.value.items.items():
                low = np.zeros(len(ids), dtype=np.int64)
                for term, w in words:
                    if term in lists:
                        docs, shares = lists[term]
                        low[docs] += w * shares.astype(np.int64)
                low = np.partition(low, len(low) - k)[-k:] if len(low) > k else low
                low = low[low > 0]
                items.append(np.full(len(low), item))
                lows.append(low)
            if items:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (items, lows)], names=["item", "low"])

    return run


def _best(wanted, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, lists in _by_block(batches):
            lists = {t: (d, s.astype(np.int64)) for t, (d, s) in lists.items()}
            key = np.array([np.iinfo(np.int64).max if x is None else x for x in ids], dtype=np.int64)
            none = np.array([x is None for x in ids], dtype=bool)
            out: list[list] = [[], [], [], []]
            for item, words in wanted.value.items.items():
                here = [(t, w) for t, w in words if t in lists]
                if not here:
                    continue
                docs, scores = nra([lists[t] for t, _ in here], np.array([w for _, w in here], dtype=np.int64), len(ids), k, wanted.value.floors.get(item, 0))
                best = np.lexsort((docs, key[docs], none[docs], -scores))[:k]
                for column, x in zip(out, ([item] * len(best), [ids[d] for d in docs[best]], scores[best].tolist(), [block * BLOCK_ROWS + int(d) for d in docs[best]]), strict=True):
                    column += x
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["item", "doc_id", "score", "place"])

    return run


def _pass(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(item, doc_id, score, rank) of queries (item, text): so few that their terms go to all tasks."""
    spark = queries.sparkSession
    words = asked(queries)
    # an item's terms are sent to all blocks with their weights, as are the asked terms to choose lists by
    names = F.broadcast(words.select("term").distinct())
    lists = index.lists.join(names, "term", "left_semi")
    df = lists.groupBy("term").agg(F.sum("df").alias("df"))
    w = F.floor(1000 * F.log(F.lit(2.0 * index.n + 2) / (2 * F.col("df") + 1)))
    weights = words.join(df, "term").select("item", "term", w.alias("w")).where("w > 0").collect()  # a pass has at most PASS_BYTES of text
    ids = index.documents.select("block", F.lit(None).cast("string").alias("term"), F.size("ids").cast("long").alias("rows"), "ids")

    def dealt(*columns: str) -> DataFrame:
        none = [F.lit(None).cast("array<int>").alias(c) for c in columns]
        rows = lists.select("block", "term", F.lit(None).cast("array<long>").alias("ids"), *columns).unionByName(ids.select("block", "term", "ids", *none))
        return rows.repartition("block").sortWithinPartitions("block", F.col("term").asc_nulls_first())

    send = spark.sparkContext.broadcast
    lows = dealt("head_docs", "head_shares").mapInArrow(_heads(send(_Wanted(weights, {})), k), "item long, low long")
    ranked = lows.select("item", "low", F.row_number().over(Window.partitionBy("item").orderBy(F.col("low").desc())).alias("_r"))
    floors = {r.item: r.low for r in ranked.where(F.col("_r") == k).collect()}  # one for each query of the pass
    found = dealt("head_docs", "head_shares", "more_docs", "more_shares").mapInArrow(_best(send(_Wanted(weights, floors)), k), "item long, doc_id long, score long, place long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "place"))
    return found.select("item", "doc_id", "score", rank.alias("rank")).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents of each row of queries (item_id, text)."""
    rows = queries.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = written(rows.withColumn("item", F.monotonically_increasing_id()), "asked")
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    passes = max(-(-n // PASS_ROWS), -(-(size or 0) // PASS_BYTES), 1)
    parts = [_pass(index, rows.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == i), k) for i in range(passes)]
    found = reduce(DataFrame.unionByName, parts)
    return found.join(rows.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return search(Index(docs), items, 10)


_FOUND = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH found AS (SELECT doc_id, {_FOUND.format('text')} AS ts FROM documents),
total AS (SELECT count(*) AS big_n, CAST(sum(len(ts)) AS BIGINT) AS l FROM found WHERE len(ts) > 0),
counted AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM found) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counted, total GROUP BY term, big_n),
asked AS (SELECT DISTINCT item_id, unnest({_FOUND.format('text')}) AS term FROM benchmark),
scored AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // l)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN counted USING (term), total GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY rank <= 10"""
