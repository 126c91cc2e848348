"""Repeated byte strings across documents, found by suffix order, and texts without them.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a document with a smaller id, or in the
same document further to the front. Strings are judged on the input.

1. Each LENGTH-byte window has an anchor: the first of its GRAM-byte strings with the least hash. Windows in a row with
   one anchor are a context, the bytes that they span. Equal windows have equal anchors, so they meet by anchor.
2. By anchor, contexts that equal an earlier one are repeats as a whole, first within each block of documents; where an
   anchor has several different ones, the first of each is wanted with its bytes. Rows are streamed in sorted order; no
   anchor's rows are held. Contexts, of at most 152 bytes, are equal here if their 64-bit hashes and those of their
   anchors are; bytes are compared only among the rest.
3. The bytes wanted come from the documents. An anchor's windows fall in families by how far they reach to its left;
   those of one family that agree on what all of them cover are compared: their strings are joined to one text and
   sorted by suffix_array, the Lyndon grouping. Windows that are neighbours in the order and equal are one class; all
   but its earliest are repeats. Where there are more than a text holds, there are several, and their classes meet by the
   windows' digests.
4. A document's repeats are merged and cut out.

Nulls: a null text is empty. A null id is less than any other and stays null. Documents with one id are ordered by a
hash of their text, 60 bits of its MD5; of rows that are equal throughout, the first is judged and the others repeat it. Texts of any
length are taken whole, in segments that overlap. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, blocks, mix, prefix_hash, range_hash, utf8, written
from .suffix_groups import suffix_array

LENGTH = 100
GRAM = 48
#: Windows of an anchor by how far they reach to its left: so many families.
FAMILIES = 4
#: Bytes that are sorted together; a family's strings share a text up to the second; contexts held of one anchor.
TEXT_BYTES, MOST_BYTES, HELD_BYTES = 1 << 14, 1 << 20, 1 << 23
#: Contexts of an anchor beyond which they are dealt to several tasks.
HOT_ROWS = 20_000
SEGMENT = 1 << 22
_PLACE = U64((1 << 24) - 1)
LEAST = -(1 << 63)
#: A context's number of windows stands in so many bits, the anchor's place in those above.
BITS = 12
LOW = (1 << BITS) - 1


def contexts(buf: np.ndarray, offs: np.ndarray, length: int, gram: int):
    """Document number, anchor hash, context hash, first window and number of windows of each context of a block; above BITS, the
    anchor's place in it."""
    n, wide = len(buf), length - gram + 1
    none = np.zeros(0, dtype=np.int64)
    if n < length:
        return none, none, none, none, none
    prefix = prefix_hash(buf)
    at = np.arange(n - gram + 1)
    g = range_hash(prefix, at, at + gram)
    least = (g & ~_PLACE) | at.astype(U64)
    size = 1
    while size * 2 <= wide:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    if wide > size:
        least = np.minimum(least[: len(least) - (wide - size)], least[wide - size :])
    count = np.maximum(np.diff(offs) - length + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    window = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + offs[:-1][doc]
    anchor = (least[window] & _PLACE).astype(np.int64)
    new = np.ones(len(window), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(window)))
    start, anchor, doc = window[first], anchor[first], doc[first]
    with np.errstate(over="ignore"):
        own = mix(range_hash(prefix, start, start + many + length - 1) + (anchor - start).astype(U64) * U64(0xA24BAED4963EE407))
    return doc, g[anchor], own, start - offs[doc], many | (anchor - start) << BITS


def _segments(offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row of pieces of at most SEGMENT windows, each with the bytes that its windows need."""
    begin, end, row = [], [], []
    for i in range(len(offs) - 1):
        a, b = int(offs[i]), int(offs[i + 1])
        for s in range(a, max(b - length + 1, a + 1), SEGMENT):
            begin.append(s)
            end.append(min(b, s + SEGMENT + length - 1))
            row.append(i)
    return np.array(begin), np.array(end), np.array(row)


FOUND = "a long, c long, did long, th long, start int, many int"


def _emit(length: int, gram: int):
    """Contexts of each document; of those that a block of documents has several times, all but the earliest are repeats
    already: many is then minus the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, th = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            buf, offs = utf8(batch.column(2))
            for i, j in blocks(offs, 1 << 20):
                here = offs[i : j + 1]
                if here[-1] - here[0] <= SEGMENT:
                    doc, a, c, start, many = contexts(buf[here[0] : here[-1]], here - here[0], length, gram)
                else:  # one long text
                    parts = []
                    for s, e, _ in zip(*_segments(here, length), strict=True):
                        doc, a, c, start, many = contexts(buf[s:e], np.array([0, e - s]), length, gram)
                        parts.append((doc, a, c, start + (s - here[0]), many))
                    doc, a, c, start, many = (np.concatenate(x) for x in zip(*parts, strict=True))
                if not len(doc):
                    continue
                a, c = a.view(np.int64), c.view(np.int64)
                doc = doc + i
                with np.errstate(over="ignore"):
                    key = mix(a.view(U64) + mix(c.view(U64)))
                # rows that are equal throughout have one place
                rank = np.unique(np.stack([did[i:j], th[i:j]]), axis=1, return_inverse=True)[1].ravel()
                place = (rank[doc - i].astype(np.int64) << 32) + start
                order = np.lexsort((place, key))
                again, twin = np.zeros((2, len(key)), dtype=bool)
                again[order[1:]] = key[order[1:]] == key[order[:-1]]
                twin[order[1:]] = again[order[1:]] & (place[order[1:]] == place[order[:-1]])
                many = np.where(again, -((many & LOW) + length - 1), many)
                columns = [a, c, did[doc], th[doc], start.astype(np.int32), many.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x[~twin]) for x in columns], names=[x.split()[0] for x in FOUND.split(", ")])

    return run


MET = "a long, did long, th long, start int, many int"


def _meet(length: int):
    """Of contexts sorted by anchor, content and place: repeats (many is minus their bytes) and contexts wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, told, last = None, False, None  # the anchor's latest first context, whether it was told; the last row
        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(6)])
            own = rows[5] < 0
            marks = [rows[:, own]]
            rows = rows[:, ~own]
            if rows.shape[1]:
                whole = rows if last is None else np.concatenate([last, rows], axis=1)
                fresh = np.zeros(int(last is None), dtype=bool)
                alike = np.concatenate([fresh, (whole[:2, 1:] == whole[:2, :-1]).all(axis=0)])
                same = np.concatenate([fresh, (whole[:5, 1:] == whole[:5, :-1]).all(axis=0)])
                last = rows[:, -1:]
                repeat = rows[:, alike & ~same].copy()  # a row that equals the last throughout is a repeated document
                repeat[5] = -((repeat[5] & LOW) + length - 1)
                marks.append(repeat)
                first = rows[:, ~alike]
                if first.shape[1]:
                    if held is not None:
                        first = np.concatenate([held, first], axis=1)
                    near = first[0, 1:] == first[0, :-1]
                    wanted = np.concatenate([[False], near]) | np.concatenate([near, [False]])
                    if held is not None and told:
                        wanted[0] = False
                        told_last = bool(near[-1]) if len(near) else True
                    else:
                        told_last = bool(wanted[-1])
                    # the latest one may be wanted only for what the next batch brings
                    marks.append(first[:, wanted])
                    held, told = first[:, -1:], told_last
            out = np.concatenate(marks, axis=1)
            if out.shape[1]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0]), pa.array(out[2]), pa.array(out[3]), pa.array(out[4].astype(np.int32)), pa.array(out[5].astype(np.int32))], names=[x.split()[0] for x in MET.split(", ")]
                )

    return run


WANTED = "a long, salt int, did long, th long, start int, many int, bytes binary"


def _slices(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            did, th, text, wanted = batch.columns[:4]
            for d, t, x, spans in zip(did.to_pylist(), th.to_pylist(), text, wanted.to_pylist(), strict=True):
                data = x.as_py().encode()
                for s in spans:
                    out.append((s["a"], s["salt"], d, t, s["start"], s["many"], data[s["start"] : s["start"] + (s["many"] & LOW) + length - 1]))
                    size += 2 * length
                if size > 1 << 22:
                    yield _wanted(out)
                    out, size = [], 0
            if out:
                yield _wanted(out)

    return run


def _wanted(out: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in WANTED.split(", ")])


SORTED = "digest binary, did long, th long, start int, size int"


def _sorted_repeats(rows: list[tuple], length: int, shared: bool) -> list[tuple]:
    """Repeats among strings (did, th, start, bytes), alike ones in order of place, by their suffixes' order.

    shared: there are more strings elsewhere, so the earliest window of each class is told too, by its digest."""
    parts = [r[3] for r in rows]
    ends = np.cumsum([len(p) + 1 for p in parts])
    data = np.frombuffer(b"\x00".join(parts) + b"\x00", dtype=np.uint8)
    number = data.astype(np.int16) + 1
    number[ends - 1] = 0
    order = np.array(suffix_array(number.tolist()))
    owner = np.repeat(np.arange(len(parts)), np.diff(ends, prepend=0))
    left = (ends - 1)[owner] - np.arange(len(data))
    order = order[left[order] >= length]
    strings = np.lib.stride_tricks.sliding_window_view(data, length)
    differs = np.ones(len(order), dtype=bool)
    for i in range(0, len(order) - 1, 1 << 16):
        part = strings[order[i : i + (1 << 16) + 1]]
        differs[i + 1 : i + len(part)] = (part[1:] != part[:-1]).any(axis=1)
    group = np.cumsum(differs) - 1
    earliest = np.full(group[-1] + 1, len(data))
    np.minimum.at(earliest, group, order)
    repeat = np.sort(order[order != earliest[group]])
    begins = np.concatenate([[0], ends[:-1]])
    out = []
    if len(repeat):
        new = np.ones(len(repeat), dtype=bool)
        new[1:] = (np.diff(repeat) != 1) | (owner[repeat[1:]] != owner[repeat[:-1]])
        first = np.flatnonzero(new)
        for s, e in zip(repeat[first].tolist(), repeat[np.append(first[1:], len(repeat)) - 1].tolist(), strict=True):
            did, th, start, _ = rows[owner[s]]
            out.append(_mark(did, th, start + s - int(begins[owner[s]]), e - s + length))
    if shared:
        for s in earliest.tolist():
            did, th, start, _ = rows[owner[s]]
            out.append((hashlib.blake2b(strings[s].tobytes(), digest_size=16).digest(), did, th, start + s - int(begins[owner[s]]), length))
    return out


def _mark(did: int, th: int, start: int, size: int) -> tuple:
    return f"{did} {th} {start}".rjust(20).encode(), did, th, start, size  # a key of its own, longer than a digest


def _sort(length: int, gram: int, families: int = FAMILIES):
    """Finds repeats among contexts that come in order of anchor, salt and place; an anchor with salts has its contexts in
    several tasks."""
    wide = length - gram + 1
    reach = [(-(-f * wide // families), -(-(f + 1) * wide // families) - 1) for f in range(families)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text: list[tuple] = []  # strings to be sorted together
        size = 0

        def alike(rows: list[tuple], part: bool) -> list[tuple]:
            """Repeats among the contexts of one anchor, as far as text needn't be sorted; part: it has more of them."""
            nonlocal size
            found, out = {}, []
            for _, _, did, th, start, many, data in rows:
                at, many = many >> BITS, many & LOW
                for f, (near, far) in enumerate(reach):
                    s, e = max(0, at - far), min(many - 1, at - near)
                    if s <= e:
                        found.setdefault((f, data[at - near : at - far + length]), []).append((did, th, start + s, data[s : e + length]))
            for strings in found.values():
                if len(strings) == 1 and not part:
                    continue
                distinct = {}
                for x in strings:
                    if x[3] in distinct:
                        out.append(_mark(x[0], x[1], x[2], len(x[3])))
                    else:
                        distinct[x[3]] = x
                strings = list(distinct.values())
                total = sum([len(x[3]) + 1 for x in strings])
                if part or total > MOST_BYTES:
                    each = max(1, MOST_BYTES // (total // len(strings) + 1))
                    for i in range(0, len(strings), each):
                        out += _sorted_repeats(strings[i : i + each], length, True)
                elif len(strings) > 1:
                    text.extend(strings)
                    size += total
                    if size >= TEXT_BYTES:
                        out += _sorted_repeats(text, length, False)
                        text.clear()
                        size = 0
            return out

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            types = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in SORTED.split(", ")])

        held: list[tuple] = []
        bytes_held, part, out = 0, False, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (row[:2] != held[-1][:2] or bytes_held >= HELD_BYTES):
                    more = row[:2] == held[-1][:2]
                    out += alike(held, part or more or held[0][1] >= 0)
                    held, bytes_held, part = [], 0, more
                    if len(out) > 50_000:
                        yield batch_of(out)
                        out = []
                held.append(row)
                bytes_held += len(row[6])
        if held:
            out += alike(held, part or held[0][1] >= 0)
        if text:
            out += _sorted_repeats(text, length, False)
        if out:
            yield batch_of(out)

    return run


def _cut(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for did, copy, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                data = text.as_py().encode()
                if copy > 1 and len(data) >= length:
                    merged = [(0, len(data))]
                else:
                    merged = []
                    for s in sorted(spans or [], key=lambda s: s["start"]):
                        a, b = s["start"], s["start"] + s["size"]
                        if merged and a <= merged[-1][1]:
                            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
                        else:
                            merged.append((a, b))
                kept, at = [], 0
                for a, b in merged:
                    kept.append(data[at:a])
                    at = b
                rest = b"".join([*kept, data[at:]])
                row = (None if did == LEAST else did, len(data), len(data) - len(rest), len(merged), hashlib.sha256(rest).hexdigest())
                out.append((*row, rest.decode("utf-8", "ignore")) if with_text else row)
            if out:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                own = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=False)]
                yield pa.RecordBatch.from_arrays([*own, batch.column(4)], names=[*[x.split()[0] for x in CUT.split(", ")][: len(own)], "carried"])

    return run


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """What is left of docs (doc_id, text) without repeated strings; with_text: the text too, without halves of characters.

    carry: columns of docs that the result has as well."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # never null, or a filter would keep the two joins with the texts from one exchange
    digest = F.coalesce(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("did"), digest.alias("th"), text.alias("text"), F.struct(F.lit(0).alias("_"), *[F.col(c) for c in carry]).alias("carried"))
    long = rows.drop("carried").where(F.octet_length("text") >= length)
    found = long.mapInArrow(_emit(length, gram), FOUND)
    # repeats that are known already go anywhere, so a context of many documents is no heavier than their blocks are many
    place = F.when(F.col("many") < 0, F.xxhash64("did", "start")).otherwise(F.col("a"))
    met = found.repartition(place).sortWithinPartitions("a", "c", "did", "th", "start").mapInArrow(_meet(length), MET)
    met = written(met, "repeats")
    # anchors with many contexts are dealt to several tasks; there is one to HOT_ROWS rows at most
    hot = met.where("many > 0").groupBy("a").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_ROWS).select("a", F.ceil(F.col("_n") / HOT_ROWS).alias("_salts"))
    hot = written(hot, "hot-anchors")
    hot = F.broadcast(hot) if hot.count() <= 1 << 18 else hot
    salt = F.coalesce(F.pmod(F.xxhash64("did", "start"), F.col("_salts")), F.lit(-1)).cast("int")
    wanted = met.where("many > 0").join(hot, "a", "left").select("a", salt.alias("salt"), "did", "th", "start", "many")
    wanted = wanted.groupBy("did", "th").agg(F.collect_list(F.struct("a", "salt", "start", "many")).alias("wanted"))
    dealt = rows.repartition(parts, "did", "th")  # the same exchange serves both joins
    # of rows that are equal throughout, any may serve
    sliced = dealt.join(wanted, ["did", "th"]).select("did", "th", "text", "wanted", "carried").mapInArrow(_slices(length), WANTED)
    ordered = sliced.repartition("a", "salt").sortWithinPartitions("a", "salt", "did", "th", "start").mapInArrow(_sort(length, gram), SORTED)
    rank = Window.partitionBy("digest").orderBy("did", "th", "start")
    apart = ordered.withColumn("_rank", F.row_number().over(rank)).where((F.length("digest") != 16) | (F.col("_rank") > 1))
    spans = met.where("many < 0").select("did", "th", F.col("start"), (-F.col("many")).alias("size")).union(apart.select("did", "th", "start", "size"))
    spans = spans.groupBy("did", "th").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    joined = dealt.join(spans, ["did", "th"], "left")
    copy = F.row_number().over(Window.partitionBy("did", "th").orderBy(F.lit(0)))
    columns = CUT if with_text else CUT.removesuffix(", kept_text string")
    done = joined.select("did", copy.alias("copy"), "text", "spans", "carried").mapInArrow(_cut(length, with_text), f"{columns}, carried {rows.schema['carried'].dataType.simpleString()}")
    return done.select(*[x.split()[0] for x in columns.split(", ")], *[F.col(f"carried.`{c}`") for c in carry])


def op4_suffix_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without strings of 100 bytes that start earlier as well."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
