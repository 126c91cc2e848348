"""Markdown notes with frontmatter, queries and settings as DataFrame sources."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Ranking
from ..functions.text import trimmed
from . import files, yaml


def read_notes(spark: SparkSession, *paths: str, depth: int | None = None) -> DataFrame:
    """(place, file, name, frontmatter, body, error) of the notes of files and folders, place being their order.

    Files may have any name; of folders it is the .md files, at most depth levels down (1: the folder itself). name is the
    file's without its ending. A file without frontmatter has an error; a path that doesn't exist is one, when the table is read."""
    spark.dataSource.register(files.Notes)
    return split(spark.read.format("notes").options(paths=json.dumps(paths), **({} if depth is None else {"depth": depth})).load())


def stream_notes(spark: SparkSession, *paths: str, log: str, depth: int | None = None) -> DataFrame:
    """As read_notes, of files as they come in or change; log is a folder of this stream's own."""
    spark.dataSource.register(files.Notes)
    return split(spark.readStream.format("notes").options(paths=json.dumps(paths), log=log, **({} if depth is None else {"depth": depth})).load())


def given_notes(spark: SparkSession, *docs: str) -> DataFrame:
    """As read_notes, of documents that are at hand, as from standard input; their file is `-`."""
    return split(spark.createDataFrame([(i, "-", "-", d, None) for i, d in enumerate(docs)], files.NOTES))


def split(docs: DataFrame) -> DataFrame:
    """docs (doc and others) in frontmatter and body: the first ends at the first line of three dashes after its own."""
    pattern = "(?s)\\A---\\n(.*?)\\n---\\n(.*)\\z"
    fits = F.coalesce(F.col("doc").rlike(pattern), F.lit(False))
    part = lambda i: F.when(fits, F.regexp_extract("doc", pattern, i))
    error = F.when(~fits, "no frontmatter")
    kept = [c for c in docs.columns if c not in ("doc", "error")]
    return docs.select(*kept, part(1).alias("frontmatter"), trimmed(part(2)).alias("body"), (F.coalesce("error", error) if "error" in docs.columns else error).alias("error"))


META = "title string, author string, domain string, intent string, kind string, status string, tags array<string>, aliases array<string>, links array<struct<target:string,rel:string>>, canonical string, problem string"
_TEXT = ("title", "author", "domain", "intent", "kind", "status")
#: The order of fields in canonical text; others follow by name.
FIRST = (*_TEXT, "tags", "aliases", "links")


def _meta(text: str | None) -> dict | None:
    if text is None:
        return None
    try:
        found = yaml.loads(text)
    except ValueError as e:
        return {"problem": str(e)}
    out = {c: found[c] for c in _TEXT if isinstance(found.get(c), str)}
    for c in ("tags", "aliases"):
        out[c] = [x for x in found.get(c, []) if isinstance(x, str)] if isinstance(found.get(c, []), list) else []
    links = found.get("links", [])
    out["links"] = [{"target": x.get("target"), "rel": x.get("rel")} for x in links if isinstance(x, dict)] if isinstance(links, list) else []
    missing = [c for c in _TEXT if c not in out] + ["tags"] * ("tags" not in found)
    out["canonical"] = yaml.dumps(found, FIRST)
    return out | {"problem": f"missing: {', '.join(missing)}" if missing else None}


def fields(notes: DataFrame) -> DataFrame:
    """notes with the struct meta of their frontmatter: the six texts, tags, aliases, links, the canonical text of all its fields
    (what is hashed: equal fields have equal texts however they were written), and a problem if there is one."""
    text, many = pa.string(), pa.list_(pa.string())
    kind = pa.struct([*[(c, text) for c in _TEXT], ("tags", many), ("aliases", many), ("links", pa.list_(pa.struct([("target", text), ("rel", text)]))), ("canonical", text), ("problem", text)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = notes_columns.index("frontmatter")
        for batch in batches:
            meta = pa.array([_meta(x) for x in batch.column(at).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, meta], names=[*notes_columns, "meta"])

    notes_columns = notes.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in notes.dtypes)
    return notes.mapInArrow(run, f"{schema}, meta struct<{META.replace(' array', ':array').replace(' string', ':string')}>")


QUERY = "query_id string, query string, relevant array<string>, class string"


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Queries with their relevant notes, one JSON object a line; blank lines are skipped and class may be missing."""
    return spark.read.schema(QUERY).json(path).where("query_id IS NOT NULL")


#: The settings of a search by section, and the fields that they set.
SETTINGS = {
    "": {"threshold": "threshold"},
    "bm25": {"top_k": "top_k"},
    "weights": {"cosine": "cosine", "graph": "graph", "engagement": "engagement", "activation": "engagement"},
    "engagement": {"half_life_hours": "half_life_hours", "saturation_reads": "saturation", "weight_recency": "recency", "weight_popularity": "popularity"},
    "graph": {"decay": "decay", "respect_domain_filter": "respect_domain"},
}


def ranking_of(text: str) -> Ranking:
    """The ranking's settings from TOML (table `search` and its tables); what isn't stated stays as it is by default."""
    search = tomllib.loads(text).get("search", {})
    given = {field: table[name] for part, names in SETTINGS.items() for table in [search.get(part, {}) if part else search] for name, field in names.items() if name in table}
    weights = {name.removeprefix("weight_"): value for name, value in search.get("bm25", {}).items() if name.startswith("weight_")}
    return replace(Ranking(), **given, fields=Ranking().fields | weights)


def write_results(results: DataFrame, path: str, mode: str = "append") -> None:
    """A JSON file in path for each of a few results (evaluation.results)."""
    results.sparkSession.dataSource.register(files.Results)
    results.write.format("results").mode(mode).save(path)
