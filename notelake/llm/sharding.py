"""Proportional stratified interleaving: every shard gets the mixture of sources that the whole has.

Rows are shuffled by a seed within their source, row r of n gets the fractional rank (r + 1/2) / n, all rows are put
in the order of that rank, and the order is cut into runs whose lengths differ by one at most.

No window sees more than a bucket of rows: a row's bucket is the leading bits of its key, which spread evenly, and the
counts of the buckets give where each bucket's ranks begin. A source with a third of the rows has thousands of buckets. The
order of fractional ranks is cut into ranges, equal fractions too, and the counts of the ranges give where each begins.

Nulls: a null source is a source of its own; a null text has size 1 and the CRC of no bytes; null ids are ranked like
others. Equal rows are interchangeable and each keeps its own place. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written


def _offsets(rows: DataFrame, group: list[str], bucket: str) -> DataFrame:
    """Where the ranks of each bucket begin within its group, and how many rows the group has."""
    counts = rows.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("_n"))
    within = Window.partitionBy(*group).orderBy(bucket) if group else Window.partitionBy(F.lit(0)).orderBy(bucket)
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    return counts.select(
        *group,
        bucket,
        (F.sum("_n").over(within.rowsBetween(Window.unboundedPreceding, -1))).alias("_before"),
        F.sum("_n").over(whole).alias("_total"),
    )


def interleave(rows: DataFrame, stratum: Column, key: Column, shards: int, seed: int = 17) -> DataFrame:
    """rows with shard and slot. key identifies a row for the seeded shuffle; the columns of rows stay."""
    own = rows.columns
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), stratum.alias("_stratum"), key.alias("_id"))
    packed = packed.withColumn("_key", F.xxhash64(F.lit(seed), "_id", "_stratum")).withColumn("_bucket", F.shiftright("_key", 52))
    # rank within the stratum
    first = _offsets(packed, ["_stratum"], "_bucket").withColumnsRenamed({"_stratum": "_s", "_bucket": "_b"})
    in_bucket = Window.partitionBy("_stratum", "_bucket").orderBy("_key", "_id")
    ranked = packed.withColumn("_rank", F.row_number().over(in_bucket)).join(
        first, F.col("_stratum").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))
    )
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.coalesce("_before", F.lit(0)))
    # (rank - 1/2) / n
    ranked = ranked.withColumn("_part", (F.col("_rank") - F.lit(0.5)) / F.col("_total")).select("_row", "_stratum", "_key", "_id", "_part")
    # of sources with the same fraction, a hash decides which comes first, not the name
    order = ["_part", "_tie", "_key", "_id"]
    ordered = ranked.withColumn("_tie", F.xxhash64(F.lit(seed + 1), "_stratum"))
    # ranges of the whole order, so that rows of one fraction, as of many sources of one row, are cut as well
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = written(ordered.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_nth", F.monotonically_increasing_id()), "ordered")
    ordered = ordered.withColumn("_range", F.shiftright("_nth", 33))  # the partition's number is above its rows'
    second = _offsets(ordered, [], "_range").withColumnRenamed("_range", "_b")
    placed = ordered.join(F.broadcast(second), F.col("_range") == F.col("_b"))  # as many rows as ranges
    at, n = F.col("_nth").bitwiseAND((1 << 33) - 1) + F.coalesce("_before", F.lit(0)), F.col("_total")
    shard = F.expr(f"(_place * {shards} + {shards - 1}) div _total")
    placed = placed.withColumn("_place", at).withColumn("_total", n)
    # shard s starts at floor(s * n / shards), so place p belongs to floor(((p + 1) * shards - 1) / n)
    placed = placed.withColumn("_shard", shard)
    placed = placed.withColumn("_slot", F.col("_place") - F.expr(f"(_shard * _total) div {shards}"))
    return placed.select("_row.*", F.col("_shard").cast("int").alias("shard"), F.col("_slot").cast("long").alias("slot"))


def op8_stratified_interleaving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law `rows`: counts at most one apart, sources in proportion."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", "source", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32")
    )
    out = interleave(docs, F.col("source"), F.struct("doc_id", "text_crc32", "size"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
