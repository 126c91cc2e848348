"""Tables between steps: written to the folder that all executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where a local session has none, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="notelake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, what: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder, read back; lineage ends there."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def held(df: DataFrame, most: int) -> DataFrame:
    """At most so many rows of df, brought to the driver and given back as a table of their own: for pools of a search."""
    rows = df.limit(most).collect()
    return df.sparkSession.createDataFrame(rows, df.schema)
