"""Cleaning of a stream: an extension, as cleaning keeps no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.clean import apply_rules, issue_log, merged
from ..plans.model import CleanRules, Mapping, Template


def read_folder(spark: SparkSession, folder: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(folder)


def write_cleaned(stream: DataFrame, template: Template, mappings: list[Mapping], out: str, checkpoint: str, rules: CleanRules | None = None, row_idx: str = "row_idx") -> StreamingQuery:
    """Each micro-batch to `out/table` and `out/issues`; a batch that is repeated overwrites its own folder."""

    def sink(batch: DataFrame, n: int) -> None:
        cleaned = apply_rules(batch, template, mappings, rules, row_idx).persist()
        merged(cleaned, template).write.mode("overwrite").parquet(f"{out}/table/batch={n}")
        issue_log(cleaned).write.mode("overwrite").parquet(f"{out}/issues/batch={n}")
        cleaned.unpersist()

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
