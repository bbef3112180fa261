"""Reports of files and batches from the issue log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def issue_counts(issues: DataFrame, *by: str) -> DataFrame:
    return issues.groupBy(*by).agg(F.count_if(F.col("severity") == "error").alias("error_count"), F.count_if(F.col("severity") == "warning").alias("warning_count"))


def file_reports(files: DataFrame, issues: DataFrame) -> DataFrame:
    """files: source_path, row_count, mapped_columns, unmapped_columns, error_message. A file is failed with a message, ok without errors, else partial."""
    counted = files.join(issue_counts(issues, "source_path"), "source_path", "left").fillna(0, ["error_count", "warning_count"])
    return counted.withColumn("status", F.when(F.coalesce(F.col("error_message"), F.lit("")) != "", "failed").when(F.col("error_count") == 0, "ok").otherwise("partial"))


def batch_report(reports: DataFrame) -> DataFrame:
    return reports.agg(F.count_if(F.col("status") == "ok").alias("ok_count"), F.count_if(F.col("status") == "failed").alias("failed_count"), F.count("*").alias("files"))
