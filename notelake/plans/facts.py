"""The fact tables of a vault of one's own: created empty, seeded, and reset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import KINDS

#: Columns of each fact table; contents are what a reset keeps.
FACTS = {
    "versions": "note_id long, seq long, prev long, author string, fm_hash string, md_hash string, content_hash string, created_at timestamp_ntz",
    "contents": "hash string, payload string",
    "tag_events": "note_id long, tag string, added boolean, place int, at timestamp_ntz",
    "status_events": "note_id long, status string, at timestamp_ntz",
    "access_events": "note_id long, ts timestamp_ntz",
    "edges": "src long, dst long, edge_type string, weight double, source_type string, context string",
    "embeddings": "note_id long, embedding array<float>, model string, updated_at timestamp_ntz",
    "audit": "event_id string, action string, target_id long, detail string, created_at timestamp_ntz",
    "kinds": "kind string",
}


def created(spark: SparkSession, folder: str) -> None:
    """Every fact table that folder lacks, empty."""
    for name, schema in FACTS.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/{name}")


def fact(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(FACTS[name]).parquet(f"{folder}/{name}")


def seeded(spark: SparkSession, folder: str) -> None:
    """The built-in kinds, each once however often it is called."""
    kinds = spark.createDataFrame([(k,) for k in KINDS], FACTS["kinds"])
    kinds.join(fact(spark, folder, "kinds"), "kind", "left_anti").write.mode("append").parquet(f"{folder}/kinds")


def reset(spark: SparkSession, folder: str, confirm: bool = False) -> dict[str, int]:
    """Rows of each fact table but contents, which it empties if confirmed."""
    names = [n for n in FACTS if n != "contents"]
    rows = {n: fact(spark, folder, n).count() for n in names}
    if confirm:
        for n in names:
            spark.createDataFrame([], FACTS[n]).write.mode("overwrite").parquet(f"{folder}/{n}")
    return rows
