"""Streams: windowed reads with a watermark, contents kept once, and their runs over files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.tables import shared_folder


def event_stream(spark: SparkSession, folder: str, schema: StructType, name: str = "*.parquet") -> DataFrame:
    """Events of the Parquet files of a folder as they come in."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def reads_by_window(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Reads by note and window; works on a stream and on a table alike."""
    views = events.where("event_type = 'view'").withColumn("at", F.col("ts").cast("timestamp"))
    if views.isStreaming:
        views = views.withWatermark("at", late)
    return views.groupBy(F.window("at", window).alias("w"), F.col("user_id").alias("note_id")).agg(F.count(F.lit(1)).alias("reads")).select("note_id", F.col("w.start").alias("start"), "reads")


def stored_once(contents: DataFrame, late: str = "2 days") -> DataFrame:
    """(hash, payload, at) of a stream of contents (payload, at), each content once within the time that rows may be late."""
    rows = contents.select(F.sha2("payload", 256).alias("hash"), "payload", "at")
    return rows.withWatermark("at", late).dropDuplicatesWithinWatermark(["hash"])


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives for all that is there now, as a table in the shared folder; mode complete keeps the last state."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    if mode == "complete":
        run = writer.outputMode("complete").foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{path}/rows")).start()
    else:
        run = writer.outputMode("append").format("parquet").option("path", f"{path}/rows").start()
    run.awaitTermination()
    if run.lastProgress is None or not run.lastProgress["sources"]:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
