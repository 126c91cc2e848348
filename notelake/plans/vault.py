"""A vault of notes as lazy DataFrames derived from append-only tables."""

from __future__ import annotations

import datetime
import hashlib
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FIELD_WEIGHTS, KINDS
from ..functions.text import title
from .tables import shared_folder, written

NOW = datetime.datetime(2024, 1, 31)
EDGE_TYPES = ["references", "depends-on", "supersedes", "contradicts", "extends", "informed-by", "unknown"]


def live(notes: DataFrame) -> DataFrame:
    """Notes that aren't retracted; one without a status isn't live."""
    return notes.where("status <> 'retracted'")


class Vault:
    """The given tables in their roles. Attributes are plans, but for notes and index, which are kept for all searches as long as the tables stay what they are."""

    def __init__(self, spark: SparkSession, folder: str, now: datetime.datetime = NOW):
        self.spark, self.folder, self.now = spark, folder, now
        self._stamps, self._notes, self._near, self._index = {}, (None, None), {}, None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def access(self) -> DataFrame:
        views = self.table("events").where("event_type = 'view'")
        return views.groupBy(F.col("user_id").alias("note_id")).agg(F.count(F.lit(1)).alias("access_count"), F.max("ts").alias("last_accessed"))

    @property
    def _documents(self) -> DataFrame:
        """What documents themselves say of their notes."""
        kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % 12 + 1).cast("int"))
        return self.table("documents").select(F.col("doc_id").alias("note_id"), title(F.col("text")).alias("title"), F.col("source").alias("domain"), F.col("lang").alias("intent"), kind.alias("kind"), F.col("text").alias("body"))

    @cached_property
    def heads(self) -> DataFrame:
        """Current state of each note, its text included; columns that a query doesn't use aren't read."""
        labels = self.table("labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
        status = F.when(F.col("t") == 1, "retracted").when(F.col("q") == 0, "deprecated").when(F.col("q") == 1, "active").otherwise("draft")
        docs = self._documents.join(labels, F.col("note_id") == F.col("doc_id"), "left")
        updated = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, cast(note_id % 720 as int))")
        heads = docs.select("note_id", "title", "domain", "intent", "kind", status.alias("status"), updated.alias("updated_at"), "body")
        return heads.join(self.access, "note_id", "left").withColumn("access_count", F.coalesce("access_count", F.lit(0)))

    @cached_property
    def bodies(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").alias("note_id"), F.col("text").alias("body"))

    def stamp(self, *tables: str) -> str:
        """What the files of tables are at this moment: changes whenever one of them is written, added to or taken from.

        Where any table's files have changed, plans are forgotten, as they hold lists of files."""
        files = self.spark.read.format("binaryFile").load(f"{self.folder}/*.parquet")
        table = F.regexp_extract("path", "([^/]+)\\.parquet(?:/[^/]*)?$", 1)
        one = F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))
        stamps = {r.t: f"{r.n} {r.x}" for r in files.groupBy(table.alias("t")).agg(F.count(F.lit(1)).alias("n"), one.alias("x")).collect()}
        if stamps != self._stamps:
            self._stamps = stamps
            for name, kind in vars(type(self)).items():
                if isinstance(kind, cached_property):
                    self.__dict__.pop(name, None)
        return ", ".join(f"{t} {stamps.get(t)}" for t in tables)

    @property
    def notes(self) -> DataFrame:
        """heads without their texts: what searches read again and again; written anew when the tables have changed."""
        stamp = self.stamp("documents", "labels", "events")
        if self._notes[0] != stamp:
            self._notes = stamp, written(self.heads.drop("body"), "notes")
        return self._notes[1]

    @property
    def index(self):
        """Full-text index of title, body, spine (a note's place) and keywords (its tags); the given tables have no aliases.

        It is stored in the shared folder under the given folder's name, so that later sessions find it; new and changed
        notes are added to it, and deleted ones taken out, when the tables have changed."""
        from ..operators.lexical import Index
        from ..operators.postings import FORMAT, Store

        stamp = self.stamp("documents", "part")
        if self._index is None:
            place = hashlib.md5(f"{FORMAT} {self.folder.rstrip('/')}".encode(), usedforsecurity=False).hexdigest()
            self._index = Index(store=Store(self.spark, f"{shared_folder(self.spark)}/index-{place}", tuple(FIELD_WEIGHTS)))
        if self._index.store.stamp != stamp:
            keywords = self.tags.groupBy("note_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), " ").alias("keywords"))
            texts = self._documents.select("note_id", "title", "body", F.concat_ws("/", "domain", "intent", "kind").alias("spine"), F.lit("").alias("aliases"))
            self._index.store.refresh(texts.join(keywords.hint("shuffle_hash"), "note_id", "left"), stamp)  # as large tables meet, so that texts are spread; they aren't sorted
            self._index.store.merge()
        return self._index

    def _vectors_of(self, what: str, tables: tuple[str, ...], rows):
        from ..operators.neighbours import FORMAT, VectorIndex

        stamp = self.stamp(*tables)
        if self._near.get(what, (None, None))[0] != stamp:
            place = hashlib.md5(f"{FORMAT} {what} {self.folder.rstrip('/')} {stamp}".encode(), usedforsecurity=False).hexdigest()
            self._near[what] = stamp, VectorIndex(self.spark, f"{shared_folder(self.spark)}/vectors-{place}", rows())
        return self._near[what][1]

    @property
    def near(self):
        """Index of all vectors, stored in the shared folder for the files that the table has now."""
        return self._vectors_of("all", ("embeddings",), lambda: self.vectors)

    @property
    def near_live(self):
        """Index of the vectors of live notes."""
        return self._vectors_of("live", ("embeddings", "documents", "labels"), lambda: self.vectors.join(live(self.notes).select("note_id"), "note_id", "left_semi"))

    @cached_property
    def edges(self) -> DataFrame:
        types = F.array(*map(F.lit, EDGE_TYPES))
        rows = self.table("lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.element_at(types, F.col("l_linenumber").cast("int")).alias("edge_type"), "l_shipdate")
        return rows.groupBy("src", "dst", "edge_type").agg(F.min("l_shipdate").alias("created_at"))

    @cached_property
    def tags(self) -> DataFrame:
        words = F.concat(F.split("p_name", " "), F.array(F.lower("p_type"), F.lower("p_brand")))
        return self.table("part").select(F.col("p_partkey").alias("note_id"), F.explode(F.array_distinct(words)).alias("tag"))

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("note_id"), "embedding", "label")

    @cached_property
    def versions(self) -> DataFrame:
        return self.table("conversations").select(F.col("conv_id").alias("note_id"), F.col("turn").alias("seq"), F.when(F.col("turn") > 0, F.col("turn") - 1).alias("prev"), F.sha2("text", 256).alias("content_hash"), "text")
