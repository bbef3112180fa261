"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """Of this application, under spark.checkpoint.dir. On one machine a temporary folder serves where that is unset."""
    at, master = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir(), spark.sparkContext.master
    if not at and master.startswith("local") and not master.startswith("local-cluster"):
        at = f"{tempfile.gettempdir()}/millrace-{spark.sparkContext.applicationId}"
    if not at:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{at.rstrip('/')}/millrace-tables/{spark.sparkContext.applicationId}"


def materialized(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet, read again: computed once, short lineage. Readable until clear()."""
    to = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)


def clear(spark: SparkSession) -> None:
    """Removes the tables of this application; for after its results are written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
