"""Notes taken in as they come: versions, contents, links, edges, postings and vectors of changed notes alone.

Every table is a folder of parts, one for each batch. A batch reads only the parts before its own and replaces its own, so
a batch that is repeated after a failure leaves what one run of it leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import embed_input
from ..operators import graph
from ..operators.mutations import STATUSES
from ..operators.postings import Store
from ..plans.tables import written
from ..sources import markdown
from ..sources.providers import Provider, embedded

HEAD = ("title", "author", "domain", "intent", "kind", "status")
TABLES = {
    "versions": f"note_id long, seq long, prev long, file string, {', '.join(f'{c} string' for c in HEAD)}, tags array<string>, aliases array<string>, fm_hash string, md_hash string, content_hash string, created_at timestamp_ntz",
    "contents": "hash string, payload string",
    "links": "src long, target string, edge_type string, source_type string, context string, pos long",
    "resolved": "src long",
    "edges": "src long, dst long, edge_type string, weight double, source_type string, context string",
    "embeddings": "note_id long, embedding array<float>, model string",
    "rejected": "file string, error string",
}
FIELDS = ("title", "body", "spine", "aliases", "keywords")


class Ingest:
    """Tables of notes below folder, the postings among them; with a provider, vectors too.

    A note's identifier is 64 bits of its file's hash; where two files would share one, the batch is an error. Of a file that
    a batch has twice, the one that comes later counts. Notes that can't be read are rejected with their error, and change
    nothing. Unchanged notes, by the hashes of their canonical fields and their body, leave no row."""

    def __init__(self, spark: SparkSession, folder: str, provider: Provider | None = None):
        self.spark, self.folder, self.provider = spark, folder.rstrip("/"), provider
        for name, schema in TABLES.items():
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.folder}/{name}/batch=-1")
        self.store = Store(spark, f"{self.folder}/postings", FIELDS)

    # ------------------------------------------------------------ reading

    def table(self, name: str, before: int | None = None, spark: SparkSession | None = None) -> DataFrame:
        """A table's rows with their batch, of batches before a number where that is stated."""
        rows = (spark or self.spark).read.schema(f"{TABLES[name]}, batch long").parquet(f"{self.folder}/{name}")
        return rows if before is None else rows.where(F.col("batch") < before)

    def heads(self) -> DataFrame:
        """The last version of each note."""
        return _last(self.table("versions"))

    def edges(self) -> DataFrame:
        """Edges as they stand: of each source those of the batch that resolved its links last."""
        last = self.table("resolved").groupBy("src").agg(F.max("batch").alias("batch"))
        return self.table("edges").join(last, ["src", "batch"]).select(*graph.EDGE)

    def vectors(self) -> DataFrame:
        rows = self.table("embeddings")
        return rows.groupBy("note_id").agg(F.max_by(F.struct("embedding", "model"), "batch").alias("x")).select("note_id", "x.*")

    # ------------------------------------------------------------ writing

    def run(self, stream: DataFrame) -> None:
        """Takes in all notes (of markdown.stream_notes) that are there now; a later run goes on behind them."""
        writer = stream.writeStream.option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True)
        writer.foreachBatch(self.batch).start().awaitTermination()

    def batch(self, notes: DataFrame, number: int) -> None:
        """Takes in notes (place, file, frontmatter, body, error) as the batch of that number."""
        spark = notes.sparkSession
        read = markdown.fields(notes.groupBy("file").agg(F.max_by(F.struct("frontmatter", "body", "error"), "place").alias("x")).select("file", "x.*"))
        error = F.coalesce("error", "meta.problem", F.when(~F.col("meta.status").isin(*STATUSES), F.concat(F.lit("no such status: "), F.col("meta.status"))))
        read = read.select(F.xxhash64("file").alias("note_id"), "file", "meta", "body", error.alias("error"))
        fm, md = F.sha2("meta.canonical", 256), F.sha2("body", 256)
        read = written(read.withColumns({"fm_hash": fm, "md_hash": md, "content_hash": F.sha2(F.concat(fm, md), 256)}), "incoming")
        self._append("rejected", read.where("error IS NOT NULL").select("file", "error"), number)
        good = read.where("error IS NULL")

        old = self.table("versions", number, spark).join(good.select("note_id"), "note_id", "left_semi")
        was = _last(old).select("note_id", F.col("seq").alias("prev"), F.col("file").alias("_file"), F.col("title").alias("_title"), F.col("content_hash").alias("_hash"))
        met = good.join(was, "note_id", "left")
        twice = good.groupBy("note_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("note_id").union(met.where("_file <> file").select("note_id"))
        if clash := twice.limit(1).collect():
            raise ValueError(f"two files share the identifier {clash[0][0]}")
        changed = written(met.where("NOT (content_hash <=> _hash)").withColumn("seq", F.coalesce(F.col("prev") + 1, F.lit(0).cast("long"))), "changed")

        payloads = changed.select(F.explode(F.array(F.struct(F.col("fm_hash").alias("hash"), F.col("meta.canonical").alias("payload")), F.struct(F.col("md_hash").alias("hash"), F.col("body").alias("payload")))).alias("x")).select("x.*").dropDuplicates(["hash"])
        self._append("contents", payloads.join(self.table("contents", number, spark).select("hash"), "hash", "left_anti"), number)
        self._append("versions", changed.select("note_id", "seq", "prev", "file", *[F.col(f"meta.{c}") for c in (*HEAD, "tags", "aliases")], "fm_hash", "md_hash", "content_hash", F.current_timestamp().cast("timestamp_ntz").alias("created_at")), number)
        self._append("links", graph.text_links(changed).unionByName(graph.stated_links(changed.select("note_id", "meta.links"))), number)
        self._resolve(changed, number, spark)
        if self.provider is not None:
            inputs = changed.select("note_id", embed_input(*[F.col(f"meta.{c}") for c in ("title", "domain", "kind", "intent", "tags")], F.col("body")).alias("input"))
            self._append("embeddings", embedded(inputs, self.provider), number)
        spine = F.concat_ws("/", "meta.domain", "meta.intent", "meta.kind").alias("spine")
        words = lambda c: F.array_join(f"meta.{c}", " ")
        if self.store.add(good.select("note_id", "meta.title", "body", spine, words("aliases").alias("aliases"), words("tags").alias("keywords"))):
            self.store.merge()

    def _append(self, name: str, rows: DataFrame, number: int) -> None:
        columns = [c.split()[0] for c in TABLES[name].split(", ")]
        rows.select(*columns).write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={number}")

    def _resolve(self, changed: DataFrame, number: int, spark: SparkSession) -> None:
        """Edges of changed notes, and of those whose links name a changed note by its identifier, its title or the one it had."""
        names = F.explode(F.array_distinct(F.array(F.col("note_id").cast("string"), F.lower("meta.title"), F.lower("_title")))).alias("name")
        names = changed.select(names).where("name IS NOT NULL").distinct()
        links, versions = self.table("links", number + 1, spark), self.table("versions", number + 1, spark)
        naming = links.join(names, F.lower("target") == F.col("name"), "left_semi").select("src")
        sources = written(naming.union(changed.select(F.col("note_id").alias("src"))).distinct(), "sources")
        # only links of a source's last version count
        last = versions.join(sources, F.col("note_id") == F.col("src"), "left_semi").groupBy(F.col("note_id").alias("src")).agg(F.max("batch").alias("batch"))
        own = written(links.join(last, ["src", "batch"], "left_semi").drop("batch"), "links")
        targets = own.select(F.lower("target").alias("name")).distinct()
        named = versions.join(targets, (F.lower("title") == F.col("name")), "left_semi").select("note_id").union(versions.join(targets, F.col("note_id").cast("string") == F.col("name"), "left_semi").select("note_id")).distinct()
        notes = _last(versions.join(named, "note_id", "left_semi")).select("note_id", "title", "status")
        self._append("edges", graph.synced(own, notes, spark.createDataFrame([], TABLES["edges"])), number)
        self._append("resolved", sources, number)


def _last(versions: DataFrame) -> DataFrame:
    """The last version of each note."""
    columns = [c for c in versions.columns if c != "note_id"]
    return versions.groupBy("note_id").agg(F.max_by(F.struct(*columns), "seq").alias("x")).select("note_id", "x.*")
