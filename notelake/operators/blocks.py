"""Tables of queries against the stored index, block by block.

Queries are packed, and a pack's postings come to a task by block as the rows that they are stored as, not note by note. In a
task a block's rows are a small matrix of phrases and notes: one step counts all phrases of the pack in it, and each query's
score is a product of its weights and that matrix. Of the k best, a task holds each query's best so far and passes these on.

A pack's definition goes to each of its tasks as a row of its own, before the blocks; so do the notes that are allowed in a
block, and their lengths, where these aren't told by postings. Packs and blocks may be any number."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import written
from .postings import Store

K1, B = 1.2, 0.75
#: Queries and phrases of a pack, notes of a task.
ASKED, PHRASED, DEAL = 256, 1 << 14, 4096
#: Phrases times notes of a matrix, about, and notes that a block counts for in it.
CELLS, MANY = 1 << 22, 128
#: Rows of a block that aren't postings: notes that are allowed, and lengths.
ALLOWED, LENGTHS = -2, -1

PHRASES = "array<struct<p:int,words:array<string>,prefix:boolean,field:string,times:int,idf:double>>"
QUERIES = f"array<struct<query_id:long,phrases:{PHRASES},program:array<struct<op:string,p:int>>>>"
POSTED = "field int, term string, notes array<long>, counts array<int>, len array<int>, places array<array<int>>"
DEALT = f"pack long, deal long, block long, {POSTED}, queries {QUERIES}"
#: Bits below a note and a field for a place; a phrase that begins before its text is at a place below ROOM.
PLACE, ROOM = 40, 1 << 20


class Pack:
    """The queries of a pack; phrases that several have are counted once."""

    def __init__(self, queries: list[dict], fields: tuple[str, ...]):
        number: dict[tuple, int] = {}
        self.queries, self.idf = [], []
        for q in queries:
            own = []
            for x in q["phrases"] or ():
                key = (tuple(x["words"]), x["prefix"], None if x["field"] is None else fields.index(x["field"]))
                if key not in number:
                    number[key] = len(number)
                    self.idf.append(x["idf"] or 0.0)
                own.append((x["p"], number[key], x["times"]))
            self.queries.append((q["query_id"], own, [(s["op"], s["p"]) for s in q["program"] or ()]))
        self.phrases = list(number)
        self.exact: dict[str, list[tuple[int, int]]] = {}
        self.begun: list[tuple[str, int, int]] = []
        for j, (words, prefix, _) in enumerate(self.phrases):
            for i, w in enumerate(words):
                if prefix and i == len(words) - 1:
                    self.begun.append((w, j, i))
                else:
                    self.exact.setdefault(w, []).append((j, i))
        self._serves: dict[str, list[tuple[int, int]]] = {}

    def serves(self, term: str) -> list[tuple[int, int]]:
        """The phrases, and a word's number in each, that a term may stand for."""
        if term not in self._serves:
            self._serves[term] = self.exact.get(term, []) + [(j, i) for w, j, i in self.begun if term.startswith(w)]
        return self._serves[term]


class Block:
    """What a pack's phrases have in one block: ids of its notes, lengths, and for each phrase that is there how often, by weights."""

    def __init__(self, pack: Pack, rows: pa.RecordBatch, weights: np.ndarray, limited: bool):
        posted = pc.greater_equal(rows.column("field"), 0)
        said, rows = rows.filter(pc.invert(posted)), rows.filter(posted)
        fields, terms = rows.column("field").to_numpy(), rows.column("term").to_pylist()
        starts, notes, counts, length = _flat(rows, "notes", "counts", "len")
        self.ids, at = np.unique(notes, return_inverse=True)
        n = len(self.ids)
        self.len = np.zeros(n)
        self.len[at] = length
        self.allowed = None if not limited else said.filter(pc.equal(said.column("field"), ALLOWED)).column("notes").flatten().to_numpy()
        told = said.filter(pc.equal(said.column("field"), LENGTHS))
        _, own, sizes = _flat(told, "notes", "len")
        if n and len(own):
            place = np.minimum(np.searchsorted(self.ids, own), n - 1)
            there = self.ids[place] == own
            self.len[place[there]] = sizes[there]
        single, several = [], {}
        for r in range(len(rows)):
            for j, i in pack.serves(terms[r]):
                words, _, only = pack.phrases[j]
                if only is None or only == fields[r]:
                    if len(words) == 1:
                        single.append((j, r))
                    else:
                        several.setdefault(j, {}).setdefault(i, []).append(r)
        several = {j: s for j, s in several.items() if len(s) == len(pack.phrases[j][0])}
        present = sorted({j for j, _ in single} | several.keys())
        self.row = {j: x for x, j in enumerate(present)}
        self.f, self.has = np.zeros((len(present), n)), np.zeros((len(present), n), dtype=bool)
        if single:
            rs = np.array([r for _, r in single])
            sizes = starts[rs + 1] - starts[rs]
            posting = np.repeat(starts[rs] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            cell = np.repeat([self.row[j] for j, _ in single], sizes) * n + at[posting]
            self.f += np.bincount(cell, counts[posting] * np.repeat(weights[fields[rs]], sizes), self.f.size).reshape(self.f.shape)
            self.has |= np.bincount(cell, minlength=self.f.size).reshape(self.f.shape) > 0
        if several:
            begins_at, keys = _keys(rows, at, starts, fields, len(weights))
        for j, words in several.items():
            # a phrase begins where all of its words stand, each as many places on as its number
            own = (np.concatenate([keys[begins_at[r] : begins_at[r + 1]] for r in rs]) - i for i, rs in words.items())
            note, field = np.divmod(reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), own) >> PLACE, len(weights))
            self.f[self.row[j]] += np.bincount(note, weights[field], n)
            self.has[self.row[j], note] = True

    def scores(self, pack: Pack, average: float):
        """(number of a query, places in ids, scores taken positive) of each query's matches."""
        if not len(self.row):
            return
        idf = np.array([pack.idf[j] for j in self.row])
        saturated = idf[:, None] * self.f * (K1 + 1) / (self.f + K1 * (1 - B + B * self.len / average)[None, :])
        fine = np.ones(len(self.ids), dtype=bool) if self.allowed is None else np.isin(self.ids, self.allowed)
        none = np.zeros(len(self.ids), dtype=bool)
        for q, (_, phrases, program) in enumerate(pack.queries):
            there = [(self.row[j], times) for _, j, times in phrases if j in self.row]
            if not there:
                continue
            # what no note can have needs no look at notes
            if not _run(program, {p: j in self.row for p, j, _ in phrases}, lambda a, b: a and b, lambda a, b: a or b, lambda a, _: a):
                continue
            of = {p: self.has[self.row[j]] if j in self.row else none for p, j, _ in phrases}
            hit = np.flatnonzero(_run(program, of, np.logical_and, np.logical_or, lambda a, b: a & ~b) & fine)
            if len(hit):
                yield q, hit, np.array([t for _, t in there]) @ saturated[np.ix_([x for x, _ in there], hit)]


def _keys(rows: pa.RecordBatch, at: np.ndarray, starts: np.ndarray, fields: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's begin, and numbers of a note, a field and a place for all places of rows, which no two places of a term share."""
    column = rows.column("places")
    sizes, inner = column.value_lengths().fill_null(0).to_numpy(), column.flatten()
    lengths = inner.value_lengths().to_numpy().astype(np.int64)
    note = at[np.repeat(sizes > 0, np.diff(starts))].astype(np.int64)
    keys = np.repeat(((note * many + np.repeat(fields, sizes)) << PLACE) + ROOM, lengths) + inner.flatten().to_numpy()
    return np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(sizes)])], keys


def _run(program: list[tuple[str, int | None]], of: dict, both, either, without):
    """A program's value, where of has that of each phrase."""
    stack = []
    for op, p in program:
        if op == "has":
            stack.append(of[p])
        else:
            b, a = stack.pop(), stack.pop()
            stack.append(both(a, b) if op == "AND" else either(a, b) if op == "OR" else without(a, b))
    return stack[0]


def _flat(rows: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    """Where each row's list begins, and the lists one behind the other; the lists are equally long, or null as a whole."""
    out = []
    for c in names:
        column = rows.column(c)
        if not out:
            out.append(np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())]).astype(np.int64))
        sizes = column.value_lengths().fill_null(0).to_numpy()
        flat = column.flatten().to_numpy(zero_copy_only=False)
        if len(flat) < out[0][-1]:  # rows without this list
            whole = np.zeros(out[0][-1], dtype=np.int64)
            whole[np.repeat(sizes > 0, np.diff(out[0]))] = flat
            flat = whole
        out.append(flat)
    return out


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Ranges of rows (pack, deal, block, rows): a definition, or a few blocks of a deal, so that their matrix has some CELLS."""
    numbers = [batch.column(c).fill_null(-1).to_numpy() for c in ("pack", "deal", "block")]
    sizes = np.concatenate([[0], np.cumsum(batch.column("rows").value_lengths().to_numpy())])
    begin = 0
    for i in range(1, batch.num_rows + 1):
        other = i == batch.num_rows or numbers[2][i] < 0 or numbers[2][begin] < 0 or numbers[1][i] != numbers[1][begin] or numbers[0][i] != numbers[0][begin]
        if other or (sizes[i + 1] - sizes[begin]) * (i + 1 - begin) * MANY > CELLS:
            yield begin, i
            begin = i


def _evaluated(fields: tuple[str, ...], weights: dict[str, float], limited: bool, make):
    """Runs each(pack, block) over the blocks of _dealt, and last(pack) behind a pack's; make gives the two, and both give batches."""
    number = np.zeros(len(fields))
    for f, w in weights.items():
        number[fields.index(f)] = w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, at, each, last = None, None, None, None
        for batch in batches:
            for a, b in _blocks(batch):
                if batch.column("block")[a].as_py() is None:
                    if batch.column("pack")[a].as_py() == at:
                        continue
                    if pack is not None:
                        yield from last(pack)
                    pack, at = Pack(batch.column("queries")[a].as_py(), fields), batch.column("pack")[a].as_py()
                    each, last = make(pack)
                else:
                    yield from each(pack, Block(pack, pa.RecordBatch.from_struct_array(batch.column("rows").slice(a, b - a).flatten()), number, limited))
        if pack is not None:
            yield from last(pack)

    return run


def _counting(pack: Pack):
    """Counts the notes that have each phrase."""
    have = np.zeros(len(pack.phrases), dtype=np.int64)

    def each(pack: Pack, block: Block) -> Iterator[pa.RecordBatch]:
        for j, x in block.row.items():
            have[j] += np.count_nonzero(block.has[x])
        return iter(())

    def last(pack: Pack) -> Iterator[pa.RecordBatch]:
        rows = [(q, p, int(have[j])) for q, own, _ in pack.queries for p, j, _ in own if have[j]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int64()))], names=["query_id", "p", "d"])

    return each, last


#: Scores that differ by less may be in either order, as sums of other orders are rounded.
NEAR = 2e-9


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that may be among the k with the greatest scores and, of rounded scores that are equal, the least ids."""
    order = np.lexsort((ids, -scores))
    s = -scores[order]
    ahead = np.searchsorted(s, s - NEAR, "right") + np.arange(len(s)) - np.searchsorted(s, s, "left")
    return order[ahead < k]


def _scoring(average: float, k: int | None):
    """Scores of all matches, or of each query's k best that a task has seen."""

    def batch(query: list, notes: list, scores: list) -> pa.RecordBatch:
        whole = lambda x, kind: pa.array(np.concatenate(x) if x else np.array([], dtype=kind))
        return pa.RecordBatch.from_arrays([whole(query, np.int64), whole(notes, np.int64), whole(scores, np.float64)], names=["query_id", "note_id", "score"])

    def make(pack: Pack):
        held: list[tuple] = [(np.array([], dtype=np.int64), np.array([]))] * len(pack.queries)
        floor = np.full(len(pack.queries), -np.inf)

        def each(pack: Pack, block: Block) -> Iterator[pa.RecordBatch]:
            query, notes, scores = [], [], []
            for q, at, score in block.scores(pack, average):
                if k is None:
                    query.append(np.full(len(at), pack.queries[q][0], dtype=np.int64))
                    notes.append(block.ids[at])
                    scores.append(score)
                    continue
                good = np.flatnonzero(score >= floor[q] - NEAR)
                if len(good):
                    ids, old = np.concatenate([held[q][0], block.ids[at[good]]]), np.concatenate([held[q][1], score[good]])
                    if len(ids) > 4 * k:
                        kept = first(old, ids, k)
                        ids, old = ids[kept], old[kept]
                        floor[q] = -np.partition(-old, k - 1)[k - 1]
                    held[q] = ids, old
            if query:
                yield batch(query, notes, scores)

        def last(pack: Pack) -> Iterator[pa.RecordBatch]:
            if k is not None:
                kept = [first(s, ids, k) for ids, s in held]
                yield batch([np.full(len(x), pack.queries[q][0], dtype=np.int64) for q, x in enumerate(kept)], [held[q][0][x] for q, x in enumerate(kept)], [held[q][1][x] for q, x in enumerate(kept)])

        return each, last

    return make


# ---------------------------------------------------------------- plans


def _words(store: Store, asked: DataFrame) -> DataFrame:
    """(query_id, p, many, field, term) of the terms that phrases' words stand for; a prefix stands for those that it begins."""
    phrases = asked.select("query_id", F.explode("phrases").alias("x")).select("query_id", "x.*").where(F.size("words") > 0)
    words = phrases.select("query_id", "p", "field", "prefix", F.size("words").alias("many"), F.posexplode("words").alias("i", "word"))
    ends = F.col("prefix") & (F.col("i") == F.col("many") - 1)
    begun = words.where(ends)
    terms = store.dictionary().select("term").distinct()
    same = (F.substring("term", 1, 1) == F.substring("word", 1, 1)) & F.col("term").startswith(F.col("word"))
    columns = ("query_id", "p", "many", "prefix", "field", "term")
    return written(words.where(~ends).withColumn("term", F.col("word")).select(*columns).unionByName(begun.join(terms, same).select(*columns)), "words")


def _dealt(index, asked: DataFrame, words: DataFrame, weights: dict[str, float], allowed: DataFrame | None) -> DataFrame:
    """(pack, deal, block, rows, queries): POSTED rows of the words (query_id, term) of asked (query_id, phrases with idf, program), in order."""
    store = index.store
    many = asked.agg(F.count(F.lit(1)).alias("queries"), F.coalesce(F.sum(F.size("phrases")), F.lit(0)).alias("phrases")).first()
    packs, deals = max(-(-many.queries // ASKED), -(-many.phrases // PHRASED), 1), max(1, index.totals["_notes"] // DEAL)
    pack, deal = F.pmod(F.xxhash64("query_id"), F.lit(packs)), F.pmod(F.xxhash64("block"), F.lit(deals))
    terms = written(words.groupBy(pack.alias("pack"), "term").agg((F.max("many") > 1).alias("placed")), "terms")  # a phrase's words need their places
    length = {1: "own", len(index.fields): "every"}.get(len(weights))
    kinds = dict(c.split(" ", 1) for c in DEALT.split(", "))
    shaped = lambda df, *own: df.select(*[F.col(c).cast(t).alias(c) if c in own else F.lit(None).cast(t).alias(c) for c, t in kinds.items()])
    rows = store.alive(store.postings_of(terms)).where(F.col("field").isin([index.fields.index(f) for f in weights])).withColumns({"deal": deal, "len": F.col(length) if length else F.lit(None), "places": F.when(F.col("placed"), F.col("places"))})
    parts = [shaped(rows, "pack", "deal", "block", "field", "term", "notes", "counts", *(["len"] if length else []), *(["places"] if terms.where("placed").limit(1).count() else []))]
    whole = asked.select(pack.alias("pack"), F.struct("query_id", "phrases", "program").alias("x")).groupBy("pack").agg(F.array_sort(F.collect_list("x"), lambda a, b: F.when(a["query_id"] < b["query_id"], -1).when(a["query_id"] > b["query_id"], 1).otherwise(0)).alias("queries"))  # some ASKED queries
    packed = written(whole, "packs")
    parts.append(shaped(packed.crossJoin(store.spark.range(deals).withColumnRenamed("id", "deal")), "pack", "deal", "queries"))
    of_blocks = []
    if allowed is not None:
        of_blocks.append(store.notes().join(allowed.select("note_id"), "note_id", "left_semi").groupBy("block").agg(F.collect_list("note_id").alias("notes")).withColumns({"field": F.lit(ALLOWED), "len": F.lit(None).cast("array<int>")}))
    if not length:
        size = reduce(lambda a, b: a + b, [F.col(f"l_{f}") for f in weights])
        of_blocks.append(store.notes().groupBy("block").agg(F.collect_list(F.struct("note_id", size.cast("int").alias("len"))).alias("x")).select("block", F.col("x.note_id").alias("notes"), F.col("x.len").alias("len"), F.lit(LENGTHS).alias("field")))
    for more in of_blocks:
        parts.append(shaped(more.withColumn("deal", deal).crossJoin(packed.select("pack")), "pack", "deal", "block", "field", "notes", "len"))
    every = reduce(DataFrame.unionByName, parts).repartition(min(packs * deals, 1 << 14), "pack", "deal")
    # a row for each block, as far fewer rows go to Python
    posted = F.struct(*[c.split()[0] for c in POSTED.split(", ")])
    return every.groupBy("pack", "deal", "block").agg(F.collect_list(posted).alias("rows"), F.first("queries", ignorenulls=True).alias("queries")).sortWithinPartitions("pack", "deal", "block")


def _rare(index, asked: DataFrame, words: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(query_id, p, d): how many living notes have each phrase. Rows of postings tell it for single words; others are counted by block."""
    store, whole = index.store, len(weights) == len(index.fields)
    told = F.lit(store.tombstones is None) & (F.col("many") == 1) & ~F.col("prefix") & (F.col("field").isNotNull() | F.lit(whole or len(weights) == 1))
    single = words.where(told)
    number = {f: index.fields.index(f) for f in weights}
    sums = [F.sum("fresh" if whole else "n").alias("d"), *[F.sum(F.when(F.col("field") == k, F.col("n"))).alias(f"d_{f}") for f, k in number.items()]]
    counts = store.postings_of(single.select("term").distinct()).where(F.col("field").isin(list(number.values()))).groupBy("term").agg(*sums)
    d = F.col("d")
    for f in weights:
        d = F.when(F.col("field") == f, F.col(f"d_{f}")).otherwise(d)
    one = single.join(counts, "term").select("query_id", "p", d.alias("d"))
    rest = words.where(~told)
    if not rest.limit(1).count():
        return one
    rest = written(rest, "words")
    theirs = asked.join(rest.select("query_id").distinct(), "query_id", "left_semi")
    wanted = rest.select("query_id", "p").distinct()
    counted = _dealt(index, theirs, rest, weights, None).mapInArrow(_evaluated(index.fields, weights, False, _counting), "query_id long, p int, d long")
    return one.unionByName(counted.groupBy("query_id", "p").agg(F.sum("d").alias("d")).join(wanted, ["query_id", "p"], "left_semi"))


def scored(index, asked: DataFrame, weights: dict[str, float], k: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, note_id, score) of the matches of asked (query_id, phrases, program), more being better; index is a lexical.Index.

    With k, of each query the k best of its matches are there, in any order, and some others. Of allowed (note_id) are the
    notes that a match may be; what a phrase counts is told by all notes."""
    weights = {f: w for f, w in weights.items() if f in index.fields}
    totals = index.totals
    total, size = totals["_notes"], sum(totals[f] for f in weights)
    words = _words(index.store, asked)
    phrases = asked.select("query_id", F.explode("phrases").alias("x")).select("query_id", "x.*")
    bare = asked.select("query_id", F.transform("phrases", lambda x: F.struct(*[x[c].alias(c) for c in ("p", "words", "prefix", "field", "times")], F.lit(None).cast("double").alias("idf"))).alias("phrases"), "program")
    rare = F.log((total - F.col("d") + 0.5) / (F.col("d") + 0.5))
    with_idf = phrases.join(_rare(index, bare, words, weights), ["query_id", "p"], "left").withColumn("idf", F.when(F.col("d").isNotNull(), F.when(rare > 0, rare).otherwise(F.lit(1e-6))))
    with_idf = with_idf.groupBy("query_id").agg(F.collect_list(F.struct("p", "words", "prefix", "field", "times", "idf")).alias("phrases"))  # a query's
    full = written(with_idf.join(asked.select("query_id", "program"), "query_id"), "queries")
    rows = _dealt(index, full, words, weights, allowed)
    return rows.mapInArrow(_evaluated(index.fields, weights, allowed is not None, _scoring(size / total if total and size else 1.0, k)), "query_id long, note_id long, score double")
