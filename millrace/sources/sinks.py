"""Where results go: workbooks, issue files, tables."""

from __future__ import annotations

import csv
import io
from pathlib import PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decode import write_xlsx

#: Header of an issue export.
ISSUE_HEADER = ("Dòng", "Cột", "Mức độ", "Loại", "Chi tiết")


def output_names(paths: list[str]) -> dict[str, str]:
    """`<stem>_standardized.xlsx` for each path; a stem that repeats is numbered, so that no output overwrites another."""
    out, seen = {}, {}
    for p in paths:
        stem = PurePosixPath(p.replace("\\", "/")).stem
        seen[stem] = seen.get(stem, 0) + 1
        out[p] = f"{stem}_standardized{'' if seen[stem] == 1 else f'_{seen[stem]}'}.xlsx"
    return out


def workbook(df: DataFrame, columns: list[str], order: str = "row_idx") -> bytes:
    """One file's rows as a workbook; rows stream through the driver in order, a partition at a time. For sheets, not for tables."""
    rows = df.orderBy(order).select(*[f"`{c}`" for c in columns]).toLocalIterator()
    return write_xlsx(columns, (list(r) for r in rows))


def write_workbooks(results: DataFrame, columns: list[str], by: str = "source_path") -> DataFrame:
    """source_path, content: a workbook for each file, made on the executors. results: by, row_idx and the columns."""
    import pandas as pd

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_idx")
        values = ([None if v is None or v != v else v for v in row] for row in pdf[columns].itertuples(index=False))
        return pd.DataFrame({"source_path": [pdf[by].iloc[0]], "content": [write_xlsx(columns, values)]})

    return results.groupBy(by).applyInPandas(make, "source_path string, content binary")


def issue_csv(issues: DataFrame) -> bytes:
    """The issue log as CSV with a byte order mark."""
    out = io.StringIO(newline="")
    writer = csv.writer(out)
    writer.writerow(ISSUE_HEADER)
    for r in issues.select("row", "column", "severity", "type", "message").toLocalIterator():
        writer.writerow(list(r))
    return out.getvalue().encode("utf-8-sig")


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    """Parquet, partitioned by a column if given: the sink for results of any size."""
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)


def issue_table(issues: DataFrame) -> DataFrame:
    return issues.select(F.col("row").alias(ISSUE_HEADER[0]), F.col("column").alias(ISSUE_HEADER[1]), F.col("severity").alias(ISSUE_HEADER[2]), F.col("type").alias(ISSUE_HEADER[3]), F.col("message").alias(ISSUE_HEADER[4]))
