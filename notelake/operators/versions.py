"""Version chains, content addressing, edits and line differences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import heading, right_trimmed
from ..plans.tables import written


def history(versions: DataFrame, note_id: int | None = None) -> DataFrame:
    """(note_id, seq, content_hash, depth) of the versions that a note's head goes back to along prev; depth 0 is the head.

    The head is a note's latest version. A version that the head doesn't go back to, as another branch's, is left out; a
    chain ends at a version without prev, whose prev isn't there, or that it has come by already. Of chains that are all
    linear, each version following the one before it (all, where versions have no prev), the order tells the depth; others are followed
    by doubling steps."""
    rows = versions if note_id is None else versions.where(F.col("note_id") == note_id)
    ordered = Window.partitionBy("note_id").orderBy("seq")
    rows = rows.select("note_id", "seq", "prev" if "prev" in rows.columns else F.lag("seq").over(ordered).alias("prev"), "content_hash")
    if rows.withColumn("_last", F.lag("seq").over(ordered)).where("NOT (prev <=> _last)").isEmpty():
        depth = F.row_number().over(Window.partitionBy("note_id").orderBy(F.col("seq").desc())) - 1
        return rows.select("note_id", "seq", "content_hash", depth.alias("depth"))
    return rows.join(chain(rows), ["note_id", "seq"]).select("note_id", "seq", "content_hash", "depth")


def chain(versions: DataFrame) -> DataFrame:
    """(note_id, seq, depth) of the versions (note_id, seq, prev) that heads go back to, each at its least depth.

    Round k knows what is less than 2^k steps back, and where 2^k steps lead from everywhere; it ends when a round finds
    nothing new, which with a cycle is when all of it is known."""
    there = versions.select("note_id", F.col("seq").alias("prev"))
    jump = written(versions.where("prev IS NOT NULL").join(there, ["note_id", "prev"], "left_semi").select("note_id", "seq", F.col("prev").alias("back")), "jumps")
    known = written(versions.groupBy("note_id").agg(F.max("seq").alias("seq")).select("note_id", "seq", F.lit(0).alias("depth")), "chain")
    step = 1
    while True:
        more = known.join(jump, ["note_id", "seq"]).select("note_id", F.col("back").alias("seq"), (F.col("depth") + step).alias("depth"))
        new = written(more.join(known, ["note_id", "seq"], "left_anti").groupBy("note_id", "seq").agg(F.min("depth").alias("depth")), "chain")
        if new.isEmpty():
            return known
        known = known.unionByName(new)
        then = jump.select("note_id", F.col("seq").alias("back"), F.col("back").alias("_further"))
        jump = written(jump.join(then, ["note_id", "back"]).select("note_id", "seq", F.col("_further").alias("back")), "jumps")
        step *= 2


def heads(versions: DataFrame) -> DataFrame:
    """The latest version of each note."""
    return versions.groupBy("note_id").agg(F.max_by(F.struct("seq", "content_hash"), "seq").alias("v")).select("note_id", "v.*")


def rollback(versions: DataFrame, to: int) -> DataFrame:
    """New versions with the content that notes had at version `to`; notes without it get none."""
    latest = heads(versions).select("note_id", F.col("seq").alias("head"))
    old = versions.where(F.col("seq") == to).select("note_id", "content_hash")
    return latest.join(old, "note_id").select("note_id", (F.col("head") + 1).alias("seq"), F.col("head").alias("prev"), "content_hash")


def hashed(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def stored(texts: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(hash, payload) to append to a content-addressed table: each new content once."""
    new = texts.select(F.sha2("text", 256).alias("hash"), F.col("text").alias("payload")).dropDuplicates(["hash"])
    return new if existing is None else new.join(existing.select("hash"), "hash", "left_anti")


def committed(versions: DataFrame, changed: DataFrame) -> DataFrame:
    """The versions to append for changed notes (note_id, frontmatter, body): each follows its note's head, or is its first.

    A content's hash is that of the two parts' hashes, one behind the other; a note whose content stays gets no version."""
    latest = heads(versions).select("note_id", F.col("seq").alias("head"), F.col("content_hash").alias("_was"))
    parts = changed.select("note_id", hashed(F.col("frontmatter")).alias("fm_hash"), hashed(F.col("body")).alias("md_hash"))
    rows = parts.withColumn("content_hash", F.sha2(F.concat("fm_hash", "md_hash"), 256)).join(latest, "note_id", "left")
    rows = rows.where("_was IS NULL OR _was <> content_hash")
    return rows.select("note_id", F.coalesce(F.col("head") + 1, F.lit(0)).alias("seq"), F.col("head").alias("prev"), "fm_hash", "md_hash", "content_hash")


# ---------------------------------------------------------------- differences


def common_before(a: list, b: list) -> np.ndarray:
    """For each j, how long the longest common subsequence of a and the first j of b is.

    Of a row of the table of lengths only the places where it steps up are kept, as the zero bits of one integer, so that a
    row follows from the last by an addition: lines times lines over the bits of a word, in space of one row."""
    place: dict = {}
    for j, x in enumerate(b):
        place[x] = place.get(x, 0) | (1 << j)
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        met = row & place.get(x, 0)
        row = ((row + met) | (row - met)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Places (in a, in b) of a longest common subsequence, by halving a and cutting b where both halves have most in common."""
    out, parts = [], [(0, len(a), 0, len(b))]
    while parts:
        i, j, k, m = parts.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        if j - i == 1:
            if a[i] in (rest := b[k:m]):
                out.append((i, k + rest.index(a[i])))
            continue
        half = (i + j) // 2
        cut = k + int(np.argmax(common_before(a[i:half], b[k:m]) + common_before(a[half:j][::-1], b[k:m][::-1])[::-1]))
        parts += [(i, half, k, cut), (half, j, cut, m)]
    return sorted(out)


def line_diff(old: list[str], new: list[str]) -> list[tuple[str, str]]:
    """A shortest edit script by lines: (' ', '-' or '+', line), deletions before additions."""
    shared = set(old) & set(new)  # other lines are in no common subsequence
    at, to = ([i for i, x in enumerate(side) if x in shared] for side in (old, new))
    script, i, j = [], 0, 0
    for x, y in [*((at[p], to[q]) for p, q in common([old[k] for k in at], [new[k] for k in to])), (len(old), len(new))]:
        script += [("-", line) for line in old[i:x]] + [("+", line) for line in new[j:y]]
        script += [(" ", old[x])] if x < len(old) else []
        i, j = x + 1, y + 1
    return script


def _paired(versions: DataFrame) -> DataFrame:
    """(note_id, seq, old, new): the lines of each version and of the one before; a null text is empty."""
    before = F.lag(F.coalesce("text", F.lit(""))).over(Window.partitionBy("note_id").orderBy("seq"))
    rows = versions.select(F.col("note_id").cast("long").alias("note_id"), F.col("seq").cast("long").alias("seq"), before.alias("old"), F.coalesce("text", F.lit("")).alias("new")).where("old IS NOT NULL")
    return rows.select("note_id", "seq", F.split("old", "\n").alias("old"), F.split("new", "\n").alias("new"))


def diffs(versions: DataFrame) -> DataFrame:
    """(note_id, seq, added, deleted): lines added and deleted from each version to the next, by a shortest edit script.

    Lines meet those of the other side by join; one that the other side doesn't have is added or deleted, whatever the rest.
    Only the numbers of lines that both have, in their orders, are compared by longest common subsequence."""
    pairs = _paired(versions)
    sides = F.array(*[F.struct(F.lit(k).alias("side"), F.col(c).alias("lines")) for k, c in enumerate(("old", "new"))])
    lines = pairs.where("old <> new").select("note_id", "seq", F.explode(sides).alias("s")).select("note_id", "seq", "s.side", F.posexplode("s.lines").alias("place", "line"))
    # a number stands for a line: its first place on either side, doubled, and the side that is there
    shared = lines.groupBy("note_id", "seq", "line").agg(F.min(F.col("place") * 2 + F.col("side")).alias("number"), F.min("side").alias("low"), F.max("side").alias("high")).where("low < high")
    met = lines.join(shared.select("note_id", "seq", "line", "number"), ["note_id", "seq", "line"])
    order = F.sort_array(F.collect_list(F.struct("side", "place", "number")))  # one note's lines
    met = met.groupBy("note_id", "seq").agg(order.alias("x")).select("note_id", "seq", *[F.transform(F.filter("x", _of_side(k)), lambda r: r["number"]).alias(c) for k, c in enumerate(("old", "new"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [int(common_before(a, b)[-1]) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.int64())], names=["note_id", "seq", "same"])

    same = met.mapInArrow(run, "note_id long, seq long, same long")
    kept = F.when(F.col("old") == F.col("new"), F.size("new")).otherwise(F.coalesce("same", F.lit(0)))
    found = pairs.join(same, ["note_id", "seq"], "left").withColumn("kept", kept.cast("long"))
    return found.select("note_id", "seq", (F.size("new") - F.col("kept")).alias("added"), (F.size("old") - F.col("kept")).alias("deleted"))


def _of_side(side: int):
    return lambda r: r["side"] == F.lit(side)


def diff_lines(versions: DataFrame) -> DataFrame:
    """(note_id, seq, place, tag, line): the edit script from each version to the next, tag being ' ', '-' or '+'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for note_id, seq, old, new in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                script = line_diff(old, new)
                n = len(script)
                yield pa.RecordBatch.from_arrays([pa.array([note_id] * n, pa.int64()), pa.array([seq] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([t for t, _ in script], pa.string()), pa.array([x for _, x in script], pa.string())], names=["note_id", "seq", "place", "tag", "line"])

    return _paired(versions).mapInArrow(run, "note_id long, seq long, place int, tag string, line string")


# ---------------------------------------------------------------- edits, as columns


def times(text: Column, part: Column) -> Column:
    """How often part occurs in text, without overlaps; an empty part never does."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")).otherwise(F.lit(0).cast("long"))


def edited(notes: DataFrame, operations: list[dict]) -> DataFrame:
    """notes (note_id, frontmatter, body) after operations in order: columns frontmatter, body and error, all or none of them.

    Operations: {"op": "set", "text"} puts a whole document; {"op": "replace", "old", "new"} demands one place in the document,
    with "all" any number, with "count" just so many, and replaces all of them; "append" and "prepend" change the body only.
    A note that an operation doesn't fit keeps its parts and has an error. Documents are `---`, frontmatter, `---`, body."""
    document = lambda fm, body: F.concat(F.lit("---\n"), fm, F.lit("---\n"), body)
    rows = notes.select("note_id", F.col("frontmatter").alias("_fm"), F.col("body").alias("_body"), F.coalesce("frontmatter", F.lit("")).alias("frontmatter"), F.coalesce("body", F.lit("")).alias("body"), F.lit(None).cast("string").alias("error"))
    pattern = "(?s)\\A---\\n(.*?\\n|)---\\n(.*)\\z"
    for op in operations:
        kind, doc, wrong = op["op"], document(F.col("frontmatter"), F.col("body")), F.lit(None).cast("string")
        if kind == "append":
            rows = rows.withColumn("body", F.concat(right_trimmed(F.col("body")), F.lit("\n"), F.lit(op["text"])))
            continue
        if kind == "prepend":
            rows = rows.withColumn("body", F.concat(F.lit(op["text"]), F.lit("\n"), F.col("body")))
            continue
        if kind == "set":
            changed = F.lit(op["text"])
        elif kind == "replace":
            n = times(doc, F.lit(op["old"]))
            fits = n > 0 if op.get("all") else n == op.get("count", 1)
            wrong = F.when(~fits, F.concat(n.cast("string"), F.lit(" places")))
            changed = F.replace(doc, F.lit(op["old"]), F.lit(op["new"]))
        else:
            raise ValueError(f"no such operation: {kind}")
        rows = rows.withColumn("_doc", changed).withColumn("error", F.coalesce("error", wrong, F.when(~F.col("_doc").rlike(pattern), "no frontmatter")))
        good = F.col("error").isNull()
        part = lambda i: F.regexp_extract("_doc", pattern, i)
        rows = rows.withColumns({"frontmatter": F.when(good, part(1)).otherwise(F.col("frontmatter")), "body": F.when(good, part(2)).otherwise(F.col("body"))}).drop("_doc")
    good = F.col("error").isNull()
    return rows.select("note_id", F.when(good, F.col("frontmatter")).otherwise(F.col("_fm")).alias("frontmatter"), F.when(good, F.col("body")).otherwise(F.col("_body")).alias("body"), "error")


def linked_body(body: Column, target: Column, rel: Column) -> Column:
    """body with a wikilink to target in the section of its relation: after the section's last link, else at its head, else in a
    new section at the end; a body that has the link somewhere stays as it is."""
    link, entry, head = F.concat(F.lit("[["), target, F.lit("]]")), F.concat(F.lit("- [["), target, F.lit("]]")), heading(rel)
    lines = F.split(F.regexp_replace(body, "\r?\n\\z", ""), "\r?\n")
    bare = F.transform(lines, lambda x: F.trim(x))
    at = F.array_position(bare, head).cast("int")
    after = F.slice(bare, at + 1, F.greatest(F.size(bare) - at, F.lit(0)))
    ends = F.filter(F.transform(after, lambda x, i: F.when(x.startswith("## "), i)), lambda i: i.isNotNull())
    section = F.slice(after, F.lit(1), F.coalesce(F.get(ends, F.lit(0)), F.size(after)))
    places = F.filter(F.transform(section, lambda x, i: F.when(x.startswith("- [["), i + 1)), lambda i: i.isNotNull())
    cut = at + F.coalesce(F.element_at(places, F.when(F.size(places) > 0, F.size(places)).otherwise(F.lit(None).cast("int"))), F.lit(0))
    inside = F.array_join(F.concat(F.slice(lines, F.lit(1), cut), F.array(entry), F.slice(lines, cut + 1, F.greatest(F.size(lines) - cut, F.lit(0)))), "\n")
    return F.when(F.contains(body, link), body).when(at > 0, inside).otherwise(F.concat(right_trimmed(body), F.lit("\n\n"), head, F.lit("\n"), entry))
