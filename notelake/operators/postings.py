"""The stored index: postings in segments, a term's files apart from others', appended to, deleted from and merged.

A segment holds the words of some notes. Its postings are rows of a term, a field and a block of notes: notes of about the same
length that one task had, or dealt to blocks by a hash where segments are merged. A row has its notes, how often they have the term, their lengths (of the field and of all
fields) and the term's places, and what bounds a score without reading these: the greatest count and the least lengths. Rows
stand in folders by a hash of their term, sorted by term and block, so that a query lists and opens the folders of its terms
only. A dictionary of terms leads from a prefix to its terms.

The list of segments is a table of versions, and writing the next version is what makes a change seen: a reader takes one
version, and what a failed writer leaves isn't in any. New and changed notes make a segment; notes that were changed or
deleted are named, with the segment that they are dead in, by tombstones; merging writes the living notes of small segments
into one. Counts of notes and words are kept for each segment, and count living notes only."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..plans.tables import written

#: Notes of a block, about; occurrences of a folder of terms, and folders of a segment at least and at most.
BLOCK, FOLDER, FOLDERS = 256, 1 << 18, (8, 4096)
#: Occurrences of a folder's task: common terms are dealt to several by their blocks.
TASK = 1 << 22
#: Where a block's number has its segment's and its kind of length; its task's and its own are below, the latter of so many bits.
SEGMENT, KIND, TURNS = 48, 32, 14
#: Bytes of text and notes that a task inverts at once, and rows of a batch that it gives.
SLICE, ROWS = (4 << 20, 4096), 1 << 15
#: Notes of a folder of terms in a segment of new notes, and its folders at most: each task writes a file in each.
NEW, NEW_FOLDERS = 1 << 13, 64
#: Segments of at most so many notes are merged once there are so many of them.
SMALL, MANY = 1 << 20, 8

#: To be raised when what is stored changes: an index of another format isn't read.
FORMAT = 3
NOTES = "note_id long, segment int, hash long, block long"
SEGMENTS = "segment int, path string, folders int, held array<int>, notes long, words map<string,long>, dead long, dead_words map<string,long>, tombstones array<string>, stamp string"


#: field counts from 0; n notes have the term in the field, and for fresh of them no earlier field has it.
POSTINGS = "term string, field int, block long, n int, fresh int, most int, least int, least_of_all int, notes array<long>, counts array<int>, own array<int>, every array<int>, places array<array<int>>"
LISTS = ("notes", "counts", "own", "every", "places")
#: Rows of postings, and such of a block's notes with their hashes and lengths by field, which have no term.
INVERTED = f"{POSTINGS}, hashes array<long>, lengths array<array<int>>"
KINDS = {"term": pa.string(), "field": pa.int32(), "block": pa.int64(), **dict.fromkeys(("n", "fresh", "most", "least", "least_of_all"), pa.int32())}
KINDS |= {"notes": pa.list_(pa.int64()), **dict.fromkeys(("counts", "own", "every"), pa.list_(pa.int32())), "places": pa.list_(pa.list_(pa.int32())), "hashes": pa.list_(pa.int64()), "lengths": pa.list_(pa.list_(pa.int32()))}


def _slices(batch: pa.RecordBatch, texts: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most SLICE bytes of text and as many notes as a slice may have, or of one note."""
    size = np.zeros(batch.num_rows, dtype=np.int64)
    for column in batch.columns[texts:]:
        size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, begin = np.cumsum(size), 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(ends, SLICE[0] + (ends[begin - 1] if begin else 0), "right"))
        end = min(max(end, begin + 1), begin + SLICE[1], batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end


def _inverted(fields: tuple[str, ...], segment: int, most: int):
    """INVERTED of rows (note_id, hash, a text for each field): notes of a slice that are about as long share blocks of at most so many.

    A task's blocks have its number, and they are its own as long as it has no more of a kind than TURNS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        turn: dict[int, int] = {}
        own = TaskContext.get().partitionId()
        for batch in batches:
            for part in _slices(batch, 2):
                yield from inverted(part, turn, own)

    def inverted(batch: pa.RecordBatch, turn: dict[int, int], own_number: int) -> Iterator[pa.RecordBatch]:
        n, ids = batch.num_rows, batch.column(0).to_numpy()
        number: dict[str, int] = {}
        terms: list[np.ndarray] = []
        lengths = np.zeros((len(fields), n), dtype=np.int32)
        for k in range(len(fields)):
            for j, text in enumerate(batch.column(2 + k)):
                found = words(text.as_py() or "")
                lengths[k, j] = len(found)
                if found:
                    terms.append(np.array([number.setdefault(w, len(number)) for w in found], dtype=np.int32))
        # a half of a doubling is one kind of length
        kind = np.floor(2 * np.log2(1 + lengths.sum(0))).astype(np.int64)
        order = np.argsort(kind, kind="stable")
        begins = np.flatnonzero(np.diff(kind[order], prepend=-1))
        within = np.empty(n, dtype=np.int64)
        within[order] = (np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))) // most
        names, place_of = np.unique(kind * n + within, return_inverse=True)
        blocks = np.empty(len(names), dtype=np.int64)
        for i, x in enumerate(names // n):
            turn[x] = turn.get(x, -1) + 1
            blocks[i] = (segment << SEGMENT) + (x << KIND) + (own_number % (1 << 32 - TURNS) << TURNS) + turn[x] % (1 << TURNS)
        order = np.argsort(place_of, kind="stable")
        ends = pa.array(np.searchsorted(place_of[order], np.arange(len(names) + 1)), pa.int32())
        listed = lambda x, kind: pa.ListArray.from_arrays(ends, pa.array(x, kind))  # noqa: B023, E731
        measured = pa.ListArray.from_arrays(ends, pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(fields), pa.int32()), pa.array(lengths.T[order].ravel())))
        yield _batch(len(names), block=pa.array(blocks), notes=listed(ids[order], pa.int64()), hashes=listed(batch.column(1).to_numpy()[order], pa.int64()), lengths=measured)
        if not number:
            return
        flat = lengths.ravel()
        term, note, field = np.concatenate(terms), np.repeat(np.tile(np.arange(n, dtype=np.int32), len(fields)), flat), np.repeat(np.arange(len(fields), dtype=np.int8), lengths.sum(1))
        place = (np.arange(len(term)) - np.repeat(np.cumsum(flat) - flat, flat)).astype(np.int32)
        del terms
        # words of one note and field stay in order
        order = np.argsort(((term.astype(np.int64) * len(names) + place_of[note]) * len(fields) + field) * n + note, kind="stable")
        term, note, field, place = term[order], note[order], field[order], place[order]
        del order
        starts = lambda *keys: np.flatnonzero(np.concatenate([[True], np.any([np.diff(k) != 0 for k in keys], axis=0)]))
        pair = starts(term, field, note)
        t, f, d = term[pair], field[pair], note[pair]
        counts = np.diff(np.append(pair, len(term))).astype(np.int32)
        row = starts(t, place_of[d], f)
        first = np.zeros(len(t), dtype=np.int32)
        first[np.unique(t.astype(np.int64) * n + d, return_index=True)[1]] = 1  # pairs of a term and a note come by field
        own, every = lengths[f, d], lengths.sum(0)[d].astype(np.int32)
        told = pa.array(list(number), pa.string())
        at = np.append(row, len(t))
        for i in range(0, len(row), ROWS):
            j = min(i + ROWS, len(row))
            r, a, b = row[i:j], at[i], at[j]
            own_ends = pa.array(at[i : j + 1] - a, pa.int32())
            listed = lambda x, kind: pa.ListArray.from_arrays(own_ends, pa.array(x[a:b], kind))  # noqa: B023, E731
            inner = np.append(pair, len(term))[a : b + 1]
            places = pa.ListArray.from_arrays(own_ends, pa.ListArray.from_arrays(pa.array(inner - inner[0], pa.int32()), pa.array(place[inner[0] : inner[-1]])))
            scalars = {"n": np.diff(at[i : j + 1]), "fresh": np.add.reduceat(first[a:b], r - a), "most": np.maximum.reduceat(counts[a:b], r - a), "least": np.minimum.reduceat(own[a:b], r - a), "least_of_all": np.minimum.reduceat(every[a:b], r - a)}
            lists = {"notes": listed(ids[d], pa.int64()), "counts": listed(counts, pa.int32()), "own": listed(own, pa.int32()), "every": listed(every, pa.int32()), "places": places}
            yield _batch(j - i, term=told.take(pa.array(t[r])), field=pa.array(f[r], pa.int32()), block=pa.array(blocks[place_of[d[r]]]), **{c: pa.array(x, pa.int32()) for c, x in scalars.items()}, **lists)

    return run


def _batch(size: int, **columns: pa.Array) -> pa.RecordBatch:
    """A batch of INVERTED of size rows; columns that aren't given are null."""
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(size, kind)) for c, kind in KINDS.items()], names=list(KINDS))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n) of rows (term, fresh), a row for each term of a batch."""
    for batch in batches:
        found = pa.table([batch.column(0), batch.column(1).cast(pa.int64())], names=["term", "n"]).group_by("term").aggregate([("n", "sum")]).select(["term", "n_sum"]).rename_columns(["term", "n"])
        yield from found.combine_chunks().to_batches()


class Store:
    """An index at a path that all executors share; fields are those of its texts."""

    def __init__(self, spark: SparkSession, path: str, fields: tuple[str, ...]):
        self.spark, self.path, self.fields = spark, path.rstrip("/"), fields
        self.version, self.segments = self._latest()

    # ------------------------------------------------------------ versions

    def _latest(self) -> tuple[int, list[dict]]:
        """The last version's number and segments, and what its texts were called."""
        self.stamp = None
        try:
            rows = self.spark.read.schema(f"{SEGMENTS}, version int").parquet(f"{self.path}/versions").orderBy(F.col("version").desc()).limit(FOLDERS[1]).collect()
        except AnalysisException:  # no version yet
            rows = []
        if not rows:
            return 0, []
        last = [r.asDict() for r in rows if r["version"] == rows[0]["version"]]
        segments = [s for s in last if s["segment"] is not None]
        try:  # what a cleared folder has lost is built again
            for part in ("notes", "terms"):
                self._read("note_id long", [f"{s['path']}/{part}" for s in segments])
            self._read(POSTINGS, [f"{s['path']}/postings/folder={k}" for s in segments for k in s["held"]])
        except AnalysisException:
            return last[0]["version"], []
        self.stamp = last[0]["stamp"]
        return last[0]["version"], segments

    def _commit(self, segments: list[dict], stamp: str | None) -> None:
        """The next version, with these segments; of two writers of the same version one fails."""
        rows = [s | {"stamp": stamp} for s in segments] or [{"stamp": stamp}]
        numbers = pa.map_(pa.string(), pa.int64())
        kinds = {"segment": pa.int32(), "path": pa.string(), "folders": pa.int32(), "held": pa.list_(pa.int32()), "notes": pa.int64(), "words": numbers, "dead": pa.int64(), "dead_words": numbers, "tombstones": pa.list_(pa.string()), "stamp": pa.string()}
        columns = [pa.array([(list(x.items()) if isinstance(x := r.get(c), dict) else x) for r in rows], kind) for c, kind in kinds.items()]
        self.spark.createDataFrame(pa.Table.from_arrays(columns, names=list(kinds))).coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/versions/version={self.version + 1}")
        self.version, self.segments = self._latest()

    # ------------------------------------------------------------ reading

    def totals(self) -> dict[str, int]:
        """Living notes, and their words by field."""
        out = {"_notes": sum(s["notes"] - s["dead"] for s in self.segments)}
        return out | {f: sum(s["words"].get(f, 0) - s["dead_words"].get(f, 0) for s in self.segments) for f in self.fields}

    def _read(self, schema: str, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def notes(self) -> DataFrame:
        """(note_id, segment, hash, block, and l_ of each field) of living notes."""
        rows = self._read(", ".join([NOTES, *(f"l_{f} int" for f in self.fields)]), [f"{s['path']}/notes" for s in self.segments])
        return self.living(rows)

    @property
    def tombstones(self) -> DataFrame | None:
        paths = sorted({p for s in self.segments for p in s["tombstones"] or ()})
        return self._read("note_id long, segment int", paths) if paths else None

    def living(self, rows: DataFrame) -> DataFrame:
        """The rows (note_id, block, ...) of living notes."""
        if self.tombstones is None:
            return rows
        gone = self.tombstones.select(F.col("note_id").alias("_n"), F.col("segment").alias("_s"))
        return rows.join(gone, (F.col("note_id") == F.col("_n")) & (F.shiftright("block", SEGMENT).cast("int") == F.col("_s")), "left_anti")

    def alive(self, rows: DataFrame) -> DataFrame:
        """The rows of POSTINGS with living notes only in their lists; rows without any go."""
        if self.tombstones is None:
            return rows
        notes = self._read(NOTES, [f"{s['path']}/notes" for s in self.segments])
        gone = notes.join(self.tombstones, ["note_id", "segment"], "left_semi").groupBy("block").agg(F.collect_set("note_id").alias("_gone"))
        left = F.filter(F.arrays_zip(*LISTS), lambda x: F.col("_gone").isNull() | ~F.array_contains("_gone", x["notes"]))
        met = rows.join(gone, "block", "left").withColumn("_x", left).where(F.size("_x") > 0)
        return met.withColumns({c: F.col(f"_x.{c}") for c in LISTS}).drop("_x", "_gone")

    def _folders(self, wanted) -> list[str]:
        """Folders of postings: wanted gives, for a number of folders, those to open."""
        at = {n: set(wanted(n)) for n in {s["folders"] for s in self.segments}}
        return [f"{s['path']}/postings/folder={k}" for s in self.segments for k in s["held"] if k in at[s["folders"]]]

    def postings(self, terms: list[str]) -> DataFrame:
        """The rows of terms; folders without one of them aren't opened."""
        paths = self._folders(lambda n: {zlib.crc32(t.encode()) % n for t in terms})
        return self._read(POSTINGS, paths).where(F.col("term").isin(terms))

    def postings_of(self, terms: DataFrame) -> DataFrame:
        """The rows of terms (term, ...), of which there may be many, with what else is said of a term."""
        paths = self._folders(lambda n: {r[0] for r in terms.select(_folder(n)).distinct().collect()})
        return self._read(POSTINGS, paths).join(terms, "term")

    def dictionary(self) -> DataFrame:
        """(term, n) of parts of each segment: notes that have a term, dead ones included."""
        return self._read("term string, n long", [f"{s['path']}/terms" for s in self.segments])

    def expanded(self, prefixes: list[str]) -> list[str]:
        """The terms that begin with one of the prefixes."""
        test = reduce(lambda a, b: a | b, [F.col("term").startswith(p) for p in prefixes], F.lit(False))
        return sorted(r.term for r in self.dictionary().where(test).select("term").distinct().collect()) if prefixes else []

    # ------------------------------------------------------------ writing

    def add(self, texts: DataFrame) -> bool:
        """As refresh, of new and changed notes: those that texts doesn't have stay as they are."""
        return self.refresh(texts, self.stamp, whole=False)

    def refresh(self, texts: DataFrame, stamp: str | None = None, whole: bool = True) -> bool:
        """Makes the index that of texts (note_id, a column for each field), and tells whether anything had changed.

        Only new and changed notes are read into a segment; those and deleted ones are dead in the segments that had them.
        Notes without an id aren't indexed."""
        texts = texts.where("note_id IS NOT NULL").select(F.col("note_id").cast("long").alias("note_id"), *[F.col(f).cast("string").alias(f) for f in self.fields])
        hashed = texts.withColumn("hash", F.xxhash64(*self.fields))
        segments, changed = [dict(s) for s in self.segments], False
        fresh = hashed
        if segments:
            known, now = self.notes(), hashed.select("note_id", "hash")
            known = known if whole else known.join(now.select("note_id"), "note_id", "left_semi")
            fresh = hashed.join(known.select("note_id", "hash"), ["note_id", "hash"], "left_anti")
            changed = self._bury(segments, known.join(now, ["note_id", "hash"], "left_anti"))
        n = fresh.count()
        if n:
            segments.append(self._write_new(fresh, n))
            changed = True
        if changed or stamp != self.stamp or not self.version:
            self._commit(segments, stamp)
        return changed

    def _bury(self, segments: list[dict], stale: DataFrame) -> bool:
        """Writes tombstones for stale notes, and counts them in their segments."""
        stale = written(stale, "stale")
        sums = stale.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"l_{f}").alias(f) for f in self.fields]).collect()  # a row for each segment
        if not sums:
            return False
        path = f"{self.path}/tombstones/{uuid.uuid4().hex}"
        stale.select("note_id", "segment").write.parquet(path)
        for r in sums:
            s = next(s for s in segments if s["segment"] == r.segment)
            s["dead"], s["tombstones"] = s["dead"] + r.n, [*(s["tombstones"] or ()), path]
            s["dead_words"] = {f: (s["dead_words"] or {}).get(f, 0) + int(r[f] or 0) for f in self.fields}
        return True

    def merge(self, small: int = SMALL, many: int = MANY) -> bool:
        """Writes the living notes of small segments as one, where there are many of them, and tells whether there were.

        The segments that it replaces stay on disk for readers of earlier versions."""
        old = [s for s in self.segments if s["notes"] - s["dead"] <= small]
        if len(old) < max(many, 1):
            return False
        numbers = [s["segment"] for s in old]
        kept = self.notes().where(F.col("segment").isin(numbers))
        spread = max(1, sum(s["notes"] - s["dead"] for s in old) // (16 * BLOCK))
        # notes keep their kind of length, and are dealt anew within it
        anew = (F.shiftright(F.col("block").bitwiseAND((1 << SEGMENT) - 1), KIND) * F.lit(1 << KIND)) + F.pmod(F.xxhash64("note_id"), F.lit(spread))
        rows = self._read(POSTINGS, [f"{s['path']}/postings/folder={k}" for s in old for k in s["held"]])
        each = self.living(rows.select("term", "field", "block", F.explode(F.arrays_zip(*LISTS)).alias("x")).select("term", "field", "block", F.col("x.notes").alias("note_id"), "x.*"))
        first = F.min("field").over(Window.partitionBy("term", "note_id"))  # as many rows as fields
        each = each.withColumn("block", anew).withColumn("first", (F.col("field") == first).cast("int"))
        whole = each.groupBy("term", "field", "block").agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum("first").cast("int").alias("fresh"), F.max("counts").alias("most"), F.min("own").alias("least"), F.min("every").alias("least_of_all"), F.collect_list(F.struct(*LISTS)).alias("x"))
        whole = whole.select("term", "field", "block", "n", "fresh", "most", "least", "least_of_all", *[F.col(f"x.{c}").alias(c) for c in LISTS])
        segment = self._write(whole, kept.select("note_id", "hash", anew.alias("block"), *[f"l_{f}" for f in self.fields]))
        self._commit([*(s for s in self.segments if s["segment"] not in numbers), segment], self.stamp)
        return True

    def _write_new(self, texts: DataFrame, n: int) -> dict:
        """A segment of n texts (note_id, hash, a column for each field). A task inverts its texts and writes the postings that it has.

        So neither texts nor postings are dealt anew, and a text's words are told once."""
        number = max((s["segment"] for s in self.segments), default=-1) + 1
        path = f"{self.path}/segments/{number}-{uuid.uuid4().hex}"
        folders = min(max(n // NEW, FOLDERS[0]), NEW_FOLDERS)
        rows = texts.select("note_id", "hash", *self.fields).mapInArrow(_inverted(self.fields, number, BLOCK), INVERTED)
        rows = rows.withColumn("folder", F.when(F.col("term").isNull(), -1).otherwise(_folder(folders)))
        rows.sortWithinPartitions("folder", "term", "block").write.partitionBy("folder").parquet(f"{path}/postings")
        of_notes = self._read("block long, notes array<long>, hashes array<long>, lengths array<array<int>>", [f"{path}/postings/folder=-1"])
        each = of_notes.select("block", F.explode(F.arrays_zip("notes", "hashes", "lengths")).alias("x"))
        each.select(F.col("x.notes").alias("note_id"), F.lit(number).alias("segment"), F.col("x.hashes").alias("hash"), "block", *[F.col("x.lengths")[k].alias(f"l_{f}") for k, f in enumerate(self.fields)]).write.parquet(f"{path}/notes")
        files = self.spark.read.schema(f"{POSTINGS}, folder int").parquet(f"{path}/postings").inputFiles()
        held = sorted({int(f.rsplit("folder=", 1)[1].split("/", 1)[0]) for f in files} - {-1})
        self._read("term string, fresh int", [f"{path}/postings/folder={k}" for k in held]).mapInArrow(_summed, "term string, n long").write.parquet(f"{path}/terms")
        return self._described(number, path, folders, held)

    def _described(self, number: int, path: str, folders: int, held: list[int]) -> dict:
        sums = self._read(", ".join([NOTES, *(f"l_{f} int" for f in self.fields)]), [f"{path}/notes"]).agg(F.count(F.lit(1)), *[F.sum(f"l_{f}") for f in self.fields]).first()
        return {"segment": number, "path": path, "folders": folders, "held": held, "notes": sums[0], "words": {f: int(x or 0) for f, x in zip(self.fields, sums[1:], strict=True)}, "dead": 0, "dead_words": {}, "tombstones": []}

    def _write(self, rows: DataFrame, notes: DataFrame) -> dict:
        """A segment of postings and notes, both with block but for the segment's number."""
        number = max((s["segment"] for s in self.segments), default=-1) + 1
        path = f"{self.path}/segments/{number}-{uuid.uuid4().hex}"
        block = F.col("block") + F.lit(number << SEGMENT)
        notes.select("note_id", F.lit(number).alias("segment"), "hash", block.alias("block"), *[f"l_{f}" for f in self.fields]).write.parquet(f"{path}/notes")
        words = sum(self._described(number, path, 0, [])["words"].values())
        folders = int(min(max(words // FOLDER, FOLDERS[0]), FOLDERS[1]))
        deals = max(1, words // (folders * TASK))
        dealt = rows.withColumn("block", block).withColumns({"folder": _folder(folders), "deal": F.pmod("block", F.lit(deals))}).repartition(int(folders * deals), "folder", "deal").drop("deal")
        dealt.sortWithinPartitions("folder", "term", "block").write.partitionBy("folder").parquet(f"{path}/postings")
        stored = self.spark.read.schema(f"{POSTINGS}, folder int").parquet(f"{path}/postings") if words else self.spark.createDataFrame([], f"{POSTINGS}, folder int")
        stored.groupBy("term").agg(F.sum("fresh").alias("n")).repartitionByRange(max(1, folders // 8), "term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
        held = sorted(r.folder for r in stored.select("folder").distinct().collect())  # at most FOLDERS
        return self._described(number, path, folders, held)


def _folder(folders: int) -> Column:
    return F.pmod(F.crc32(F.encode("term", "UTF-8")), F.lit(folders)).cast("int")
