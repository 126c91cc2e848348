"""Counters of notes kept by a stream: reads, the last of them, links out and in, and whether a note has become quiet.

State is a row for each note. Events are added up inside each batch of a task first, so that a note with a third of all
events brings its state a few rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "note_id long, reads long, last long, links_out long, links_in long"
COUNTERS = "note_id long, access_count long, last_accessed timestamp, links_out long, links_in long, quiet boolean"
_SUMS = {"reads": "sum", "last": "max", "links_out": "sum", "links_in": "sum"}


def reads(accesses: DataFrame) -> DataFrame:
    """EVENTS of accesses (note_id, ts); those without a note count for none."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return accesses.where("note_id IS NOT NULL").select(F.col("note_id").cast("long").alias("note_id"), F.lit(1).cast("long").alias("reads"), at.alias("last"), F.lit(0).cast("long").alias("links_out"), F.lit(0).cast("long").alias("links_in"))


def links(changes: DataFrame) -> DataFrame:
    """EVENTS of changes of edges (src, dst, n): n is 1 for an edge that was made and -1 for one that is gone."""
    n, none = F.col("n").cast("long"), F.lit(0).cast("long")
    end = lambda note, out, into: F.struct(F.col(note).cast("long").alias("note_id"), out.alias("links_out"), into.alias("links_in"))
    ends = changes.select(F.explode(F.array(end("src", n, none), end("dst", none, n))).alias("x")).select("x.*").where("note_id IS NOT NULL")
    return ends.select("note_id", none.alias("reads"), F.lit(None).cast("long").alias("last"), "links_out", "links_in")


def summed(events: DataFrame) -> DataFrame:
    """EVENTS with one row for each note of each batch on the way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = pa.Table.from_batches([batch]).group_by("note_id").aggregate(list(_SUMS.items()))
            yield from sums.select(["note_id", *[f"{c}_{how}" for c, how in _SUMS.items()]]).rename_columns(["note_id", *_SUMS]).to_batches()

    return events.select("note_id", *_SUMS).mapInArrow(run, EVENTS)


def counters(events: DataFrame, idle_ms: int = 7 * 24 * 3600 * 1000) -> DataFrame:
    """COUNTERS of a stream of EVENTS, a row whenever a note's change; no event is dropped for coming late.

    A note that has had no event for idle_ms milliseconds of the stream's run is told once more, as quiet, with the counts
    that it keeps; its next event takes that back."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last, out, into = state.get if state.exists else (0, None, 0, 0)
        for part in parts if not state.hasTimedOut else ():
            n, out, into = n + int(part["reads"].sum()), out + int(part["links_out"].sum()), into + int(part["links_in"].sum())
            latest = part["last"].max()
            last = last if pd.isna(latest) else int(latest) if last is None else max(last, int(latest))
        if not state.hasTimedOut:
            state.update((n, last, out, into))
            state.setTimeoutDuration(idle_ms)
        at = pd.Series([None if last is None else pd.Timestamp(last, unit="us", tz="UTC")], dtype="datetime64[us, UTC]")
        yield pd.DataFrame({"note_id": [key[0]], "access_count": [n], "last_accessed": at, "links_out": [out], "links_in": [into], "quiet": [state.hasTimedOut]})

    kept = "n long, last long, links_out long, links_in long"
    return summed(events).groupBy("note_id").applyInPandasWithState(step, COUNTERS, kept, "update", GroupStateTimeout.ProcessingTimeTimeout)


def stored(stream: DataFrame, folder: str) -> None:
    """Runs counters for all events that are there now, each batch's rows in a part of folder; a batch that is repeated
    replaces its part, and a later run goes on with the state of this one.

    Notes that have become quiet are told with the next events: batches without any would follow each other without end,
    as a state with timers always asks for one more."""

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    conf, name = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")  # a query takes its settings when it starts
    try:
        query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start()
    finally:
        conf.set(name, before)
    query.awaitTermination()


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """COUNTERS as they stand after the batches stored in folder."""
    spark.createDataFrame([], COUNTERS).write.mode("ignore").parquet(f"{folder}/rows/batch=-1")
    rows = spark.read.schema(f"{COUNTERS}, batch long").parquet(f"{folder}/rows")
    columns = [c for c in rows.columns if c not in ("note_id", "batch")]
    return rows.groupBy("note_id").agg(F.max_by(F.struct(*columns), "batch").alias("x")).select("note_id", "x.*")
