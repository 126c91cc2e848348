"""Faceted browsing, statistics, tags and bulk filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.vault import live


def groups(notes: DataFrame, by: str, **within) -> DataFrame:
    """Number of live notes by domain, intent or kind, below the levels given; a null group is left out."""
    rows = reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), within.items(), live(notes))
    return rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("notes"))


def facets(notes: DataFrame, by: str) -> DataFrame:
    """As groups, with null as a group."""
    return live(notes).groupBy(by).agg(F.count(F.lit(1)).alias("notes"))


def listing(notes: DataFrame, domain: str, intent: str, kind: str, limit: int = 50) -> DataFrame:
    rows = live(notes).where((F.col("domain") == domain) & (F.col("intent") == intent) & (F.col("kind") == kind))
    return rows.select("note_id", "title", "updated_at").orderBy(F.col("updated_at").desc(), "note_id").limit(limit)


def overview(notes: DataFrame) -> DataFrame:
    n = live(notes)
    return n.agg(F.count(F.lit(1)).alias("notes"), F.coalesce(F.sum("access_count"), F.lit(0)).alias("reads"), F.count_if(F.col("access_count") == 0).alias("never_read"))


def recent(notes: DataFrame, limit: int = 5) -> DataFrame:
    return live(notes).select("note_id", "title", "updated_at").orderBy(F.col("updated_at").desc(), "note_id").limit(limit)


def most_accessed(notes: DataFrame) -> DataFrame:
    return live(notes).where("access_count > 0").select("note_id", "title", "access_count").orderBy(F.col("access_count").desc(), "note_id").limit(1)


def with_all_tags(tags: DataFrame, wanted: list[str]) -> DataFrame:
    """Notes that have every tag wanted; one that is wanted twice can't be met."""
    return tags.where(F.col("tag").isin(wanted)).groupBy("note_id").agg(F.count_distinct("tag").alias("n")).where(F.col("n") == len(wanted)).select("note_id")


def with_each_tag(notes: DataFrame, tags: DataFrame, wanted: list[str]) -> DataFrame:
    """notes that have every tag wanted, one semi-join a tag; a tag that is wanted twice changes nothing."""
    return reduce(lambda d, t: d.join(tags.where(F.col("tag") == t).select("note_id"), "note_id", "left_semi"), wanted, notes)


def tag_usage(tags: DataFrame, notes: DataFrame) -> DataFrame:
    kept = notes.where("status <> 'retracted'").select("note_id")
    return tags.join(kept, "note_id", "left_semi").groupBy("tag").agg(F.count(F.lit(1)).alias("notes"))


def tags_of(tags: DataFrame) -> DataFrame:
    return tags.groupBy("note_id").agg(F.array_join(F.array_sort(F.collect_list("tag")), " ").alias("tags"))


def bulk(notes: DataFrame, tags: DataFrame, *, domain=None, kind=None, wanted=(), since=None, before=None) -> DataFrame:
    """Notes for a bulk operation, the latest first; at least one filter is needed."""
    if not (domain or kind or wanted or since or before):
        raise ValueError("a bulk operation needs a filter")
    rows = notes.where("status <> 'retracted'")
    tests: list[Column] = [F.col(c) == v for c, v in (("domain", domain), ("kind", kind)) if v]
    tests += [F.col("updated_at") >= F.lit(since)] * bool(since) + [F.col("updated_at") <= F.lit(before)] * bool(before)
    rows = reduce(lambda d, t: d.where(t), tests, rows)
    if wanted:
        rows = rows.join(with_all_tags(tags, list(wanted)), "note_id", "left_semi")
    return rows.select("note_id", "title", "updated_at").orderBy(F.col("updated_at").desc(), "note_id")


def resolved_prefixes(notes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(prefix, notes, note_id) of prefixes of ids: how many notes begin with each, and the one where it is the only one.

    Prefixes meet ids by their own lengths, one join for each length."""
    ids = notes.select("note_id", F.lower(F.col("note_id").cast("string")).alias("_id"))
    sizes = [r[0] for r in prefixes.select(F.length("prefix")).distinct().orderBy(F.length("prefix")).collect()]  # at most an id's length
    met = [prefixes.where(F.length("prefix") == n).select("prefix").distinct().join(ids.select("note_id", F.substring("_id", 1, n).alias("_p")), F.lower("prefix") == F.col("_p"), "left") for n in sizes]
    every = reduce(DataFrame.union, met) if met else prefixes.select("prefix", F.lit(None).cast("long").alias("note_id"), F.lit(None).cast("string").alias("_p")).where(F.lit(False))
    return every.groupBy("prefix").agg(F.count("note_id").alias("notes"), F.min("note_id").alias("_least")).select("prefix", "notes", F.when(F.col("notes") == 1, F.col("_least")).alias("note_id"))


def resolve(notes: DataFrame, prefix: str) -> int:
    """The one note whose id begins with prefix; none or several are errors. Two ids at most reach the driver."""
    found = notes.where(F.lower(F.col("note_id").cast("string")).startswith(prefix.lower())).select("note_id").limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{'no note' if not found else 'more than one note'} for {prefix!r}")
    return found[0][0]
