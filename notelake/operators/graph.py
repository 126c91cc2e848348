"""The typed graph of notes: links in texts, their targets, neighbours, degrees, one-hop expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EDGE_WEIGHTS
from ..functions.text import trimmed, wikilinks

EDGE = ("src", "dst", "edge_type", "weight", "source_type", "context")


def weight(edge_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in EDGE_WEIGHTS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, edge_type), F.lit(1.0))


def resolved(links: DataFrame, notes: DataFrame, target: str = "target") -> DataFrame:
    """links with dst: the live note whose id the target is, else the least live one with that title in any case; null without."""
    live = notes.where("status <> 'retracted'")
    ids = live.select(F.col("note_id").alias("_by_id"), F.col("note_id").cast("string").alias("_id"))
    titles = live.where("title IS NOT NULL").groupBy(F.lower("title").alias("_title")).agg(F.min("note_id").alias("_by_title"))
    met = links.join(ids, F.col(target) == F.col("_id"), "left").join(titles, F.lower(target) == F.col("_title"), "left")
    return met.withColumn("dst", F.coalesce("_by_id", "_by_title")).drop("_by_id", "_id", "_by_title", "_title")


def text_links(texts: DataFrame) -> DataFrame:
    """(src, target, edge_type, source_type, context, pos) of the wikilinks of texts (note_id, body), each target once."""
    lines = texts.select(F.col("note_id").alias("src"), F.posexplode(F.split("body", "\n")).alias("line", "text")).where(F.contains("text", F.lit("[[")))
    found = lines.select("src", "line", "text", F.posexplode(wikilinks(F.col("text"))).alias("part", "target"))
    first = found.groupBy("src", "target").agg(F.min(F.struct("line", "part", "text")).alias("x"))  # a note's links are in one task already
    pos = F.col("x.line").cast("long") * (1 << 32) + F.col("x.part")
    return first.select("src", "target", F.lit("references").alias("edge_type"), F.lit("body").alias("source_type"), trimmed(F.col("x.text")).alias("context"), pos.alias("pos"))


def stated_links(notes: DataFrame) -> DataFrame:
    """As text_links, of the frontmatter's links: notes (note_id, links array of (target, rel))."""
    found = notes.select(F.col("note_id").alias("src"), F.posexplode("links").alias("pos", "x")).withColumn("pos", F.col("pos").cast("long"))
    return found.select("src", "x.target", F.col("x.rel").alias("edge_type"), F.lit("frontmatter").alias("source_type"), F.lit(None).cast("string").alias("context"), "pos")


def synced(links: DataFrame, notes: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges of notes from all their links and the edges kept (made by similarity), one for each source, destination and type.

    Kept edges come first, then links in the body, then those in the frontmatter; dead links and links to oneself go."""
    found = resolved(links, notes).where("dst IS NOT NULL AND dst <> src").withColumn("weight", weight(F.col("edge_type")))
    rank = F.when(F.col("source_type") == "body", 1).otherwise(2)
    every = found.select(*EDGE, rank.alias("_rank"), "pos").unionByName(kept.select(*EDGE, F.lit(0).alias("_rank"), F.lit(0).cast("long").alias("pos")))
    first = Window.partitionBy("src", "dst", "edge_type").orderBy("_rank", "pos", "context")
    return every.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*EDGE)


def touched(old: DataFrame, new: DataFrame) -> DataFrame:
    """Notes whose degrees a change of edges may change: destinations of old and new ones, and their sources."""
    ends = old.select(F.col("dst").alias("note_id")).union(new.select("dst")).union(old.select("src")).union(new.select("src"))
    return ends.distinct()


def neighbors(edges: DataFrame, notes: DataFrame, note_id: int | None = None) -> DataFrame:
    """Edges from and to a note, or from and to each note, with the other note's title; notes that don't exist are left out, retracted ones not."""
    titles = notes.select(F.col("note_id").alias("other"), "title")
    away = edges.select(F.col("src").alias("note_id"), F.lit("out").alias("direction"), F.col("dst").alias("other"), "edge_type")
    back = edges.select(F.col("dst").alias("note_id"), F.lit("in").alias("direction"), F.col("src").alias("other"), "edge_type")
    both = away.union(back)
    if note_id is not None:
        both = both.where(F.col("note_id") == note_id).drop("note_id")
    return both.join(titles, "other")


def degrees(edges: DataFrame, notes: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("src").alias("note_id")).agg(F.count(F.lit(1)).alias("links_out"))
    into = edges.groupBy(F.col("dst").alias("note_id")).agg(F.count(F.lit(1)).alias("links_in"))
    none = F.lit(0).cast("long")
    return notes.select("note_id").join(out, "note_id", "left").join(into, "note_id", "left").select("note_id", F.coalesce("links_out", none).alias("links_out"), F.coalesce("links_in", none).alias("links_in"))


def touching(edges: DataFrame, notes: DataFrame) -> DataFrame:
    """(src, dst, edge_type) of the edges from or to notes (note_id, repeats allowed); all edges are read once."""
    own = notes.select("note_id").distinct()
    s, t = own.select(F.col("note_id").alias("_s")), own.select(F.col("note_id").alias("_t"))
    e = edges.select("src", "dst", "edge_type")
    return e.join(s, F.col("src") == F.col("_s"), "left").join(t, F.col("dst") == F.col("_t"), "left").where("_s IS NOT NULL OR _t IS NOT NULL").select("src", "dst", "edge_type")


def expand(seeds: DataFrame, edges: DataFrame, decay: float = 0.5, by: str | None = None) -> DataFrame:
    """(note_id, graph) that seeds (note_id, seed) pass on over one hop, in both directions; by: a column that keeps searches apart.

    An edge counts once for each end that is a seed, so one between two seeds counts double in either direction. An edge
    of type supersedes passes nothing, either way, if its source is a seed. Only edges that touch a seed are read on."""
    own = [] if by is None else [by]
    s = seeds.select(F.col("note_id").alias("_s"), F.col("seed").alias("_from"), *[F.col(c).alias("_bs") for c in own])
    t = seeds.select(F.col("note_id").alias("_t"), F.col("seed").alias("_to"), *[F.col(c).alias("_bt") for c in own])
    e = edges.select("src", "dst", "edge_type")
    from_s, to_t = F.col("src") == F.col("_s"), F.col("dst") == F.col("_t")
    same = F.col("_bs") == F.col("_bt") if own else F.lit(True)
    out = e.join(s, from_s).join(t, to_t & same, "left")
    into = e.join(t, to_t).join(s, from_s & same, "left")
    ends = ["src", "dst", "edge_type", "_from", "_to"]
    met = out.select(*ends, *[F.col("_bs").alias(c) for c in own]).union(into.select(*ends, *[F.col("_bt").alias(c) for c in own]))
    met = met.where("NOT (edge_type = 'supersedes' AND _from IS NOT NULL)").withColumn("w", weight(F.col("edge_type")) * F.lit(decay))
    ways = F.array(F.struct(F.col("dst").alias("note_id"), (F.col("_from") * F.col("w")).alias("g")), F.struct(F.col("src").alias("note_id"), (F.col("_to") * F.col("w")).alias("g")))
    return met.select(*own, F.explode(ways).alias("x")).select(*own, "x.*").where("g IS NOT NULL").groupBy(*own, "note_id").agg(F.sum("g").alias("graph"))
