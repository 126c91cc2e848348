"""What changes a vault, as tables to append or as the state after it; nothing is updated in place.

Facts are append-only: versions, tag events, status events, access events, audit rows. Every function returns the rows to
append, or a view of the facts as they stand afterwards; one that takes a selection of notes returns its plan, and
appending it is the confirmation."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import KINDS
from ..functions.text import tag_checked, title, trimmed

STATUSES = ("active", "deprecated", "retracted", "draft")


def at(now: datetime.datetime) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def selected(notes: DataFrame, ids: DataFrame | None, matching: DataFrame | None) -> DataFrame:
    """Notes for a change: by ids, all of which have to exist, or by a selection (note_id), not by both."""
    if (ids is None) == (matching is None):
        raise ValueError("a change is by ids or by filters")
    if matching is not None:
        return notes.join(matching.select("note_id"), "note_id", "left_semi")
    missing = [str(r[0]) for r in ids.select("note_id").join(notes.select("note_id"), "note_id", "left_anti").orderBy("note_id").limit(20).collect()]
    if missing:
        raise ValueError(f"no such notes: {', '.join(missing)}")
    return notes.join(ids.select("note_id"), "note_id", "left_semi")


def audited(notes: DataFrame, action: str, now: datetime.datetime, detail: Column | None = None) -> DataFrame:
    """An audit row for each note; its identifier follows from action, note and time, so a repeated append shows."""
    key = F.sha2(F.concat_ws("|", F.lit(action), F.col("note_id").cast("string"), at(now).cast("string")), 256)
    return notes.select(key.alias("event_id"), F.lit(action).alias("action"), F.col("note_id").alias("target_id"), (F.lit(None).cast("string") if detail is None else detail).alias("detail"), at(now).alias("created_at"))


# ---------------------------------------------------------------- heads


def upserted(heads: DataFrame, new: DataFrame) -> DataFrame:
    """Heads after new ones: a note's new head replaces all of it but its accesses; new notes have none."""
    kept = heads.join(new.select("note_id"), "note_id", "left_anti")
    counts = heads.select("note_id", "access_count", "last_accessed")
    fresh = new.drop("access_count", "last_accessed").join(counts, "note_id", "left").withColumn("access_count", F.coalesce("access_count", F.lit(0).cast("long")))
    return kept.unionByName(fresh.select(*kept.columns))


def retracted(heads: DataFrame, notes: DataFrame, now: datetime.datetime) -> DataFrame:
    """Heads after a soft delete of notes (note_id): their texts, tags and vectors stay."""
    marked = heads.join(notes.select("note_id").distinct().withColumn("_gone", F.lit(True)), "note_id", "left")
    return marked.withColumns({"status": F.when(F.col("_gone"), "retracted").otherwise(F.col("status")), "updated_at": F.when(F.col("_gone"), at(now)).otherwise(F.col("updated_at"))}).drop("_gone")


def without(table: DataFrame, notes: DataFrame, *columns: str) -> DataFrame:
    """The rows of a table after a hard delete: those that name a deleted note in none of the columns."""
    gone = notes.select("note_id").distinct()
    for c in columns:
        table = table.join(gone.select(F.col("note_id").alias("_gone")), F.col(c) == F.col("_gone"), "left_anti")
    return table


def degree_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(note_id, links_out, links_in) of the notes whose degrees (of graph.degrees) aren't what they were."""
    was = before.select("note_id", F.col("links_out").alias("_o"), F.col("links_in").alias("_i"))
    return after.join(was, "note_id", "left").where("NOT (links_out <=> _o AND links_in <=> _i)").select("note_id", "links_out", "links_in")


def orphaned(contents: DataFrame, uses: DataFrame, notes: DataFrame) -> DataFrame:
    """Hashes of contents that deleted notes used and no other note does: uses (note_id, hash)."""
    gone = uses.join(notes.select("note_id"), "note_id", "left_semi").select("hash").distinct()
    rest = uses.join(notes.select("note_id"), "note_id", "left_anti").select("hash")
    return contents.select("hash").join(gone, "hash", "left_semi").join(rest, "hash", "left_anti")


def purged(contents: DataFrame, uses: DataFrame, notes: DataFrame) -> DataFrame:
    """Contents (hash, payload) after a hard delete of notes: those that only deleted notes used are gone, and shared ones, and
    ones that no note has used, stay."""
    return contents.join(orphaned(contents, uses, notes), "hash", "left_anti")


# ---------------------------------------------------------------- tags


def tag_events(notes: DataFrame, add: list[str], remove: list[str], now: datetime.datetime) -> DataFrame:
    """(note_id, tag, added, at) for each note and tag; a tag that is added and removed ends removed, as removals come last."""
    events = [(tag_checked(t), True) for t in dict.fromkeys(add)] + [(tag_checked(t), False) for t in dict.fromkeys(remove)]
    if not events:
        raise ValueError("a change of tags needs tags")
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(a).alias("added"), F.lit(i).alias("place")) for i, (t, a) in enumerate(events)]))
    return notes.select("note_id", each.alias("x")).select("note_id", "x.tag", "x.added", "x.place", at(now).alias("at"))


def tags_after(tags: DataFrame, events: DataFrame) -> DataFrame:
    """Tags (note_id, tag) after events: the last event of a note and tag decides."""
    last = events.groupBy("note_id", "tag").agg(F.max_by("added", F.struct("at", "place")).alias("added"))
    return tags.select("note_id", "tag").join(last, ["note_id", "tag"], "left_anti").unionByName(last.where("added").select("note_id", "tag"))


def keywords(tags: DataFrame) -> DataFrame:
    """(note_id, keywords): a note's tags by name, apart by blanks."""
    return tags.groupBy("note_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), " ").alias("keywords"))


# ---------------------------------------------------------------- accesses and vectors


def accessed(notes: DataFrame, now: datetime.datetime) -> DataFrame:
    """(note_id, ts): an access event for each note that was read."""
    return notes.select("note_id", at(now).alias("ts"))


def counted(accesses: DataFrame, events: DataFrame) -> DataFrame:
    """Counts (note_id, access_count, last_accessed) after more events."""
    more = events.groupBy("note_id").agg(F.count(F.lit(1)).alias("access_count"), F.max("ts").alias("last_accessed"))
    return accesses.select("note_id", "access_count", "last_accessed").unionByName(more).groupBy("note_id").agg(F.sum("access_count").alias("access_count"), F.max("last_accessed").alias("last_accessed"))


def latest_vectors(vectors: DataFrame) -> DataFrame:
    """The last vector (note_id, embedding, model, updated_at) of each note."""
    rank = F.row_number().over(Window.partitionBy("note_id").orderBy(F.col("updated_at").desc(), "model"))
    return vectors.withColumn("_n", rank).where("_n = 1").drop("_n")


def backfill(notes: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """(note_id) of live notes to embed: those without a vector, or all of them where any vector is of another model."""
    live = notes.where("status <> 'retracted'").select("note_id")
    if not vectors.where(~F.col("model").eqNullSafe(model)).isEmpty():
        return live
    return live.join(vectors.select("note_id"), "note_id", "left_anti")


# ---------------------------------------------------------------- new notes


def captured(drafts: DataFrame, templates: DataFrame) -> DataFrame:
    """Whole notes from drafts (draft_id, body; title, domain, intent, kind, status, tags and template where stated).

    What a draft doesn't state comes from its template, a note; what that lacks, from the defaults. A title is the body's
    first line. error: no body, no domain, no such template, or a kind or status that there isn't."""
    t = templates.select(F.col("note_id").alias("_t"), *[F.col(c).alias(f"_{c}") for c in ("domain", "intent", "kind", "status", "tags")])
    rows = drafts.join(t, F.col("template") == F.col("_t"), "left").withColumn("body", trimmed(F.coalesce("body", F.lit(""))))
    none = F.array().cast("array<string>")
    rows = rows.withColumns({
        "title": F.coalesce("title", title(F.col("body"))), "domain": F.coalesce("domain", "_domain"), "intent": F.coalesce("intent", "_intent", F.lit("research")),
        "kind": F.coalesce("kind", "_kind", F.lit("reference")), "status": F.coalesce("status", "_status", F.lit("active")), "tags": F.when(F.size(F.coalesce("tags", none)) > 0, F.col("tags")).otherwise(F.coalesce("_tags", none)),
    })
    error = F.when(F.col("template").isNotNull() & F.col("_t").isNull(), "no such template").when(F.col("domain").isNull(), "no domain")
    error = error.when(~F.col("kind").isin(KINDS), "no such kind").when(~F.col("status").isin(*STATUSES), "no such status").when(F.col("body") == "", "empty body")
    return rows.select("draft_id", "title", "domain", "intent", "kind", "status", "tags", "body", error.alias("error"))
