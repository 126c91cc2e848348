"""From raw documents to packed sequences: quality rules, near-duplicates, repeated strings, best-fit packing.

Each stage takes all that its predecessor kept and, but for the last, returns the columns of documents. Wherever stages
choose between documents, they go by doc_id, null before all others, and by the MD5 of the text where ids are equal.

Nulls: a null text is empty, so the first stage rejects it; null languages and sources are groups of their own; rows of
null or repeated ids are documents like others. Repeated rows are copies: one stays. Very long texts are taken whole.
Columns that documents doesn't have are dropped. An empty table gives an empty table at each stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm import near_dup, packing, quality, suffix_dedup
from notelake.llm.common import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of its own for each row, in the order of doc_id and the text's MD5: the doc_id where ids are unique.

    Otherwise rows are dealt by ranges of that order, and their keys are numbered along it; equal rows are split by a number."""
    docs = docs.select(*COLUMNS)
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if ids.where("n > 1 OR doc_id IS NULL").isEmpty():
        return docs.withColumn("key", F.col("doc_id").cast("long"))
    order = [F.col("doc_id").asc_nulls_first(), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).asc(), F.col("_row").asc()]
    rows = docs.withColumn("_row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    return written(rows.drop("_row").withColumn("key", F.monotonically_increasing_id()), "keyed")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and aren't outliers of their language and source; null and empty texts fail."""
    rows = _keyed(docs)
    stats = written(quality.measured(rows.select(F.col("key").alias("doc_id"), "lang", "source", "text")), "stats")
    kept = quality.judged(stats).where("kept").select(F.col("doc_id").alias("key"))
    return rows.join(kept, "key", "left_semi").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near-duplicates; equal texts without words are a class as well."""
    rows = _keyed(docs)
    classes = near_dup.near_duplicates(rows.select(F.col("key").alias("doc_id"), "text"))
    first = classes.where("doc_id = class_id").select(F.col("doc_id").alias("key"))
    return rows.join(first, "key", "left_semi").select(*COLUMNS)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings of 100 bytes that start earlier as well; n_chars counts what is left.
    A document all of whose text is repeated stays with an empty text, a null text becomes one."""
    rows = _keyed(docs).select(F.col("key").alias("doc_id"), "text", F.col("doc_id").alias("id"), "lang", "source")
    left = suffix_dedup.remove_repeats(rows, with_text=True, carry=("id", "lang", "source"))
    return left.select(F.col("id").alias("doc_id"), F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its place in a sequence of at most 4096 tokens; an empty text is
    one piece of one token."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_duplicates), ("repeated strings", repeated_strings), ("best-fit packing", best_fit_packing)]

#: No stage but the counts of the first can be told in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
