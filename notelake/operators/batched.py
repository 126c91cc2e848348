"""Search for whole tables of queries: one plan for all of them, without a query's rows ever reaching the driver.

A query is parsed where its row is, into phrases and a program that combines them, which is run over the notes of a block of
postings at a time (blocks.py). Pools, graph expansion, scales and blend all go by query. Statistics, weights and rules are those of a single search (lexical.py, ranking.py). A query that can't be parsed
has an error row and no results."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Ranking
from ..plans.tables import written
from ..plans.vault import live
from .blocks import scored
from .graph import expand, touching
from .lexical import Both, Index, Phrase, all_phrases, parse, scored_phrases
from .ranking import engagement
from .vectors import dot

PARSED = "query_id long, phrases array<struct<p:int,words:array<string>,prefix:boolean,field:string,times:int>>, program array<struct<op:string,p:int>>, error string"


def _program(tree, number: dict) -> list[tuple[str, int | None]]:
    """The tree's phrases and operators, an operator behind what it joins."""
    if isinstance(tree, Phrase):
        return [("has", number[tree])]
    return [*_program(tree.left, number), *_program(tree.right, number), (tree.how, None)]


def parsed(queries: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """PARSED of queries (query_id, query); of a malformed one only query_id and error."""

    def one(query: str | None) -> tuple:
        try:
            tree: Phrase | Both = parse(query or "", fields)
        except ValueError as e:
            return None, None, str(e)
        number = {p: i for i, p in enumerate(dict.fromkeys(all_phrases(tree)))}
        times = scored_phrases(tree)
        phrases = [{"p": i, "words": list(p.words), "prefix": p.prefix, "field": p.field, "times": times.count(p)} for p, i in number.items()]
        return phrases, [{"op": op, "p": p} for op, p in _program(tree, number)], None

    kinds = [pa.list_(pa.struct([("p", pa.int32()), ("words", pa.list_(pa.string())), ("prefix", pa.bool_()), ("field", pa.string()), ("times", pa.int32())])), pa.list_(pa.struct([("op", pa.string()), ("p", pa.int32())])), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(q) for q in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)]], names=["query_id", "phrases", "program", "error"])

    return queries.select(F.col("query_id").cast("long"), F.col("query").cast("string")).mapInArrow(run, PARSED)


def bm25(index: Index, asked: DataFrame, weights: dict[str, float], k: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, note_id, bm25) of all matches of asked (PARSED); with k, of each query's k best of the allowed notes (note_id), and some others."""
    return scored(index, asked, weights, k, allowed).select("query_id", "note_id", (-F.col("score")).alias("bm25"))


def best(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The k first rows of each query, with rank from 1."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def hybrid(vault, queries: DataFrame, cfg: Ranking | None = None) -> tuple[DataFrame, DataFrame]:
    """The hits (query_id, note_id, cosine, graph, engagement, final, rank) of queries (query_id, query, embedding), and error rows.

    As ranking.search in its normal mode, for each query: the best matches and the nearest live notes, what the graph passes on
    from them, and the blend; a query without embedding goes by its words. Error rows are (query_id, phase, message)."""
    cfg = cfg or Ranking()
    asked = written(parsed(queries, vault.index.fields), "queries")
    failed = asked.where("error IS NOT NULL").select("query_id", F.lit("search").alias("phase"), F.col("error").alias("message"))
    asked = asked.where("error IS NULL")
    vectors = queries.join(asked.select("query_id"), "query_id", "left_semi").where("embedding IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), "embedding")
    notes = live(vault.notes)
    words = best(bm25(vault.index, asked, cfg.fields, cfg.top_k, notes.select("note_id")), cfg.top_k, F.round("bm25", 9), F.col("note_id"))
    near = vault.near_live.nearest(vectors, cfg.top_k, itself=True)
    pool = words.select("query_id", "note_id", (F.col("rank") - 1).alias("rank")).unionByName(near.select("query_id", "note_id", F.lit(None).cast("int").alias("rank")))
    pool = written(pool.groupBy("query_id", "note_id").agg(F.min("rank").alias("rank")), "pool")
    sizes = pool.groupBy("query_id").agg(F.count(F.lit(1)).alias("all"), F.count("rank").alias("ranked")).join(vectors.select("query_id", F.lit(True).alias("by_vector")), "query_id", "left")
    seeds = pool.join(sizes.select("query_id", "all"), "query_id").select("query_id", "note_id", F.when(F.col("rank").isNotNull(), 1 - F.col("rank") / F.col("all")).otherwise(F.lit(0.5)).alias("seed"))
    passed = expand(seeds, written(touching(vault.edges, pool.select("note_id")), "edges"), cfg.decay, by="query_id")
    none = lambda kind: F.lit(None).cast(kind)
    every = passed.select("query_id", "note_id", "graph", none("int").alias("rank")).unionByName(pool.select("query_id", "note_id", none("double").alias("graph"), "rank"))
    found = every.groupBy("query_id", "note_id").agg(F.coalesce(F.max("graph"), F.lit(0.0)).alias("graph"), F.max("rank").alias("rank")).join(notes.select("note_id", "access_count", "last_accessed", "updated_at"), "note_id")
    top = F.max("graph").over(Window.partitionBy("query_id"))  # some thousand candidates a query
    found = found.withColumn("top", top).withColumn("graph", F.when(F.col("top") > 0, F.col("graph") / F.col("top")).otherwise(F.col("graph")))
    # only candidates' vectors are multiplied
    theirs = vault.vectors.select("note_id", F.col("embedding").alias("_v"))
    found = found.join(theirs, "note_id", "left").join(vectors.select("query_id", F.col("embedding").alias("_q")), "query_id", "left").join(sizes, "query_id")
    found = found.withColumn("cosine", F.coalesce(F.when(F.size("_v") == F.size("_q"), dot(F.col("_v"), F.col("_q"))), F.lit(0.0)))
    by_words = F.when(F.col("rank").isNotNull(), 1 - F.col("rank") / F.greatest("ranked", F.lit(1))).otherwise(F.lit(0.0))
    primary = F.when(F.coalesce("by_vector", F.lit(False)), F.col("cosine")).otherwise(by_words)
    found = found.withColumn("engagement", engagement(vault.now, cfg)).withColumn("final", primary * F.lit(cfg.cosine) + F.col("graph") * F.lit(cfg.graph) + F.col("engagement") * F.lit(cfg.engagement))
    scored = found.where((F.col("final") >= cfg.threshold) & ~F.isnan("final"))
    hits = best(scored, cfg.limit, F.round("final", 9).desc(), F.col("note_id"))
    return hits.select("query_id", "note_id", "cosine", "graph", "engagement", "final", "rank"), failed
