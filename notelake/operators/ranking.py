"""Hybrid ranking: pools of candidates, graph expansion, engagement, blend, threshold, hits."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Ranking
from ..functions.text import cut_at_word, trimmed
from ..plans.tables import held, written
from ..plans.vault import live
from .browse import with_all_tags
from .graph import expand
from .lexical import snippets
from .vectors import dot


@dataclass(frozen=True)
class Filters:
    """What hits have to be: equal in domain, kind and intent, with all tags, updated from since to before, both included."""

    domain: str | None = None
    kind: str | None = None
    intent: str | None = None
    tags: tuple[str, ...] = ()
    since: datetime.datetime | None = None
    before: datetime.datetime | None = None

    def guard(self, query: str) -> None:
        if not (query or self.domain or self.kind or self.intent or self.tags):
            raise ValueError("a search needs a query, or a filter besides times")

    def apply(self, notes: DataFrame, tags: DataFrame) -> DataFrame:
        for name in ("domain", "kind", "intent"):
            if value := getattr(self, name):
                notes = notes.where(F.col(name) == value)
        if self.since:
            notes = notes.where(F.col("updated_at") >= F.lit(self.since).cast("timestamp_ntz"))
        if self.before:
            notes = notes.where(F.col("updated_at") <= F.lit(self.before).cast("timestamp_ntz"))
        return notes.join(with_all_tags(tags, list(self.tags)), "note_id", "left_semi") if self.tags else notes


def engagement(now: datetime.datetime, cfg: Ranking) -> Column:
    """Recency by half-life since the last access or update, and reads on a saturating scale."""
    at = F.greatest(F.col("last_accessed"), F.col("updated_at"))
    seconds = F.greatest(F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(at.cast("timestamp")), F.lit(0))
    recent = F.when(at.isNull(), F.lit(0.30)).otherwise(F.exp(-(seconds / F.lit(3600.0)) * F.log(F.lit(2.0)) / F.lit(cfg.half_life_hours)))
    read = F.least(F.lit(1.0), F.log1p(F.coalesce(F.col("access_count"), F.lit(0)).cast("double")) / F.log1p(F.lit(cfg.saturation)))
    return recent * F.lit(cfg.recency) + read * F.lit(cfg.popularity)


def lexical_pool(vault, query: str, filters: Filters, cfg: Ranking) -> list[tuple]:
    """(note_id, rank) of the best top_k matches that the filters allow, ranked from 0."""
    best = vault.index.top(query, cfg.top_k, cfg.fields, filters.apply(live(vault.notes), vault.tags))
    return [(r.note_id, i) for i, r in enumerate(best.collect())]


def cosine_pool(vault, vector: list[float], filters: Filters, cfg: Ranking) -> list[int]:
    """The nearest top_k of all live notes with vectors of the query's size, and of these the allowed ones."""
    v = F.array(*[F.lit(float(x)) for x in vector])
    near = vault.vectors.where(F.size("embedding") == len(vector)).join(live(vault.notes).select("note_id"), "note_id", "left_semi").select("note_id", dot(F.col("embedding"), v).alias("cosine"))
    near = held(near.orderBy(F.col("cosine").desc(), "note_id").limit(cfg.top_k), cfg.top_k)
    if filters != Filters():
        near = near.join(filters.apply(live(vault.notes), vault.tags).select("note_id"), "note_id", "left_semi")
    return [r.note_id for r in near.select("note_id").collect()]


def recent_pool(vault, filters: Filters, cfg: Ranking) -> list[int]:
    rows = filters.apply(live(vault.notes), vault.tags)
    return [r.note_id for r in rows.orderBy(F.col("updated_at").desc(), "note_id").limit(cfg.top_k).select("note_id").collect()]


NOTE = ("note_id", "title", "domain", "kind", "access_count", "last_accessed", "updated_at")


def blended(pool: DataFrame, notes: DataFrame, edges: DataFrame, vectors: DataFrame | None, query: list[float] | None, now, cfg: Ranking, domain: str | None = None) -> DataFrame:
    """Candidates of pool (note_id, rank; at most 2 top_k rows) and what the graph adds, with their scores, best first, at most limit.

    domain: what the graph adds has to be of it, where the configuration respects it."""
    size = pool.agg(F.count(F.lit(1)).alias("all"), F.count("rank").alias("ranked")).first()
    seed = F.when(F.col("rank").isNotNull(), 1 - F.col("rank") / F.lit(max(size["all"], 1))).otherwise(F.lit(0.5))
    passed = expand(F.broadcast(pool.select("note_id", seed.alias("seed"))), edges, cfg.decay)
    found = passed.join(F.broadcast(pool.select("note_id", "rank", F.lit(True).alias("_seed"))), "note_id", "full_outer").join(live(notes).select(*NOTE), "note_id")
    if cfg.respect_domain and domain:
        found = found.where(F.col("_seed").isNotNull() | (F.col("domain") == domain))
    found = written(found.withColumn("graph", F.coalesce("graph", F.lit(0.0))), "candidates")
    top = found.agg(F.max("graph")).first()[0] or 0.0
    if top > 0:
        found = found.withColumn("graph", F.col("graph") / F.lit(top))
    if vectors is not None and query is not None:
        v = F.array(*[F.lit(float(x)) for x in query])
        found = found.join(vectors.where(F.size("embedding") == len(query)).select("note_id", dot(F.col("embedding"), v).alias("cosine")), "note_id", "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))
        primary = F.col("cosine")
    else:
        found = found.withColumn("cosine", F.lit(0.0))
        primary = F.when(F.col("rank").isNotNull(), 1 - F.col("rank") / F.lit(max(size["ranked"], 1))).otherwise(F.lit(0.0))
    found = found.withColumn("engagement", engagement(now, cfg))
    final = primary * F.lit(cfg.cosine) + F.col("graph") * F.lit(cfg.graph) + F.col("engagement") * F.lit(cfg.engagement)
    return cut(found.withColumn("final", final), cfg)


def cut(scored: DataFrame, cfg: Ranking) -> DataFrame:
    return scored.where((F.col("final") >= cfg.threshold) & ~F.isnan("final")).orderBy(F.col("final").desc(), "note_id").limit(cfg.limit)


def search(vault, query: str = "", mode: str = "normal", vector: list[float] | None = None, filters: Filters | None = None, cfg: Ranking | None = None) -> DataFrame:
    """Scored notes for a query or a filter: modes normal, bm25 (no vectors, no graph) and semantic (recent notes by vector).

    Pools of at most top_k notes are held by the driver while their scores are computed."""
    cfg, filters = cfg or Ranking(), filters or Filters()
    filters.guard(query)
    if mode == "semantic" and (vector is None or not query):
        raise ValueError("a semantic search needs a query and its vector")
    if mode == "semantic" or not query and mode != "bm25":
        pool = [(n, None) for n in recent_pool(vault, filters, cfg)]
    else:
        pool = lexical_pool(vault, query, filters, cfg)
        if mode != "bm25" and vector is not None:
            pool += [(n, None) for n in cosine_pool(vault, vector, filters, cfg) if n not in dict(pool)]
    rows = vault.spark.createDataFrame(pa.table({"note_id": pa.array([n for n, _ in pool], pa.int64()), "rank": pa.array([r for _, r in pool], pa.int32())}))
    if mode == "bm25":
        ranked = vault.notes.join(F.broadcast(rows), "note_id").select(*NOTE, "rank").withColumn("engagement", engagement(vault.now, cfg))
        return cut(ranked.withColumn("final", F.lit(0.75) * (1 - F.col("rank") / F.lit(max(len(pool), 1))) + F.lit(0.25) * F.col("engagement")), cfg)
    use = vault.vectors if vector is not None and query else None
    return blended(rows, vault.notes, vault.edges, use, vector, vault.now, cfg, filters.domain)


def hits(vault, found: DataFrame, query: str, cfg: Ranking | None = None, preview: int = 150) -> DataFrame:
    """What a search shows of the notes it found (at most limit): title, place, degrees, score and a snippet.

    A note without a snippet shows the beginning of its body, at most so many bytes."""
    cfg = cfg or Ranking()
    top = held(found.select("note_id", "title", "domain", "kind", "final"), cfg.limit)
    ids = [r.note_id for r in top.select("note_id").collect()]
    bodies = vault.bodies.where(F.col("note_id").isin(ids))
    shown = bodies.select("note_id", trimmed(cut_at_word(F.col("body"), preview)).alias("preview"))
    if query:
        shown = shown.join(snippets(bodies, query), "note_id").select("note_id", F.coalesce(F.nullif("snippet", F.lit("")), "preview").alias("snippet"))
    else:
        shown = shown.withColumnRenamed("preview", "snippet")
    out = vault.edges.where(F.col("src").isin(ids)).groupBy(F.col("src").alias("note_id")).agg(F.count(F.lit(1)).alias("links_out"))
    into = vault.edges.where(F.col("dst").isin(ids)).groupBy(F.col("dst").alias("note_id")).agg(F.count(F.lit(1)).alias("links_in"))
    none = F.lit(0).cast("long")
    rows = top.join(shown, "note_id", "left").join(into, "note_id", "left").join(out, "note_id", "left")
    return rows.select("note_id", "title", "domain", "kind", "final", "snippet", F.coalesce("links_in", none).alias("links_in"), F.coalesce("links_out", none).alias("links_out"))


def as_json(found: DataFrame, query: str, domain: str | None = None, mode: str = "normal") -> DataFrame:
    """(json) of hits, one row: the query, its domain and mode, how many hits there are (at most a search's limit), and the hits in order.

    mode is bm25, semantic or normal. Absent values are null, and without hits results are empty."""
    if mode not in ("bm25", "semantic", "normal"):
        raise ValueError(f"no such mode: {mode}")
    hit = F.struct(F.col("note_id").alias("id"), "title", "domain", "kind", "snippet", F.col("final").alias("rank"), "links_in", "links_out")
    rows = F.array_sort(F.collect_list(F.struct((-F.col("final")).alias("_a"), F.col("note_id").alias("_b"), hit.alias("x"))))
    told = found.agg(F.transform(rows, lambda r: r["x"]).alias("results"))
    text = lambda x: F.lit(x).cast("string")
    return told.select(F.to_json(F.struct(text(query).alias("query"), text(domain).alias("domain"), text(mode).alias("mode"), F.size("results").alias("hits"), "results"), {"ignoreNullFields": "false"}).alias("json"))


# ---------------------------------------------------------------- commands made of a search


def about(vault, topic: str, limit: int = 3, filters: Filters | None = None, cfg: Ranking | None = None) -> DataFrame:
    """The notes on a topic, without vectors, each with the first 500 bytes of its body."""
    cfg = replace(cfg or Ranking(), limit=limit)
    return hits(vault, search(vault, topic, filters=filters, cfg=cfg), "", cfg, preview=500).withColumnRenamed("snippet", "body_preview")


def recently_updated(vault, filters: Filters, since: datetime.datetime) -> DataFrame:
    """The number of live notes that the filters allow and that were updated since; one row."""
    return filters.apply(live(vault.notes).where(F.col("updated_at") >= F.lit(since).cast("timestamp_ntz")), vault.tags).agg(F.count(F.lit(1)).alias("notes"))


def briefing(vault, query: str = "", filters: Filters | None = None, limit: int = 5, cfg: Ranking | None = None) -> str:
    """A text on the most relevant notes, their tags and what was updated within seven days."""
    cfg, filters = replace(cfg or Ranking(), limit=limit), filters or Filters()
    found = search(vault, query, filters=filters, cfg=cfg)
    rows = hits(vault, found, "", cfg, preview=300).join(vault.notes.select("note_id", F.date_format("updated_at", "yyyy-MM-dd").alias("day")), "note_id").orderBy(F.col("final").desc(), "note_id").collect()
    ids = [r.note_id for r in rows]
    tags = [r.tag for r in vault.tags.where(F.col("note_id").isin(ids)).select("tag").distinct().orderBy("tag").collect()]
    out = [f"# Vault Briefing: {query or 'vault'}\n\n## Key Notes ({len(rows)} most relevant)\n\n"]
    for r in rows:
        text = (r.snippet or "").replace("\n", "\n> ")
        out.append(f"### {r.title}\n- Domain: {r.domain} | Kind: {r.kind}\n- Updated: {r.day}\n> {text}\n\n")
    if tags:
        out.append(f"## Active Tags\n{', '.join(tags)}\n\n")
    n = recently_updated(vault, filters, vault.now - datetime.timedelta(days=7)).first().notes
    scope = " (matching filters)" if filters.domain or filters.kind or filters.tags else ""
    return "".join(out) + f"## Recent Activity\n{n} notes updated in last 7 days{scope}\n"
