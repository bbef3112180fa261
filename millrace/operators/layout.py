"""Tables from words and boxes on a page, by gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: First cells of rows that are page marks.
MARKS = ("Sheet1", "Page 1", "Page")


def word_rows(words: DataFrame, by: list[str], gap: float = 10.0) -> DataFrame:
    """words: by, text, x0, x1, top. A row for each line (tops rounded to 5) with its cells: words not further apart than gap join."""
    line = F.bround(F.col("top") / 5) * 5
    order = Window.partitionBy(*by, "y").orderBy("x0", "x1")
    cells = words.withColumn("y", line).withColumn("cell", F.sum(F.when(F.col("x0") - F.lag("x1").over(order) > gap, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = cells.groupBy(*by, "y", "cell").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "x1", "text"))), lambda x: x["text"]), " ").alias("text"))
    return _rows(joined, by, "y", "cell")


def _rows(cells: DataFrame, by: list[str], line: str, cell: str) -> DataFrame:
    rows = cells.groupBy(*by, line).agg(F.transform(F.array_sort(F.collect_list(F.struct(cell, "text"))), lambda x: x["text"]).alias("cells"))
    rows = rows.where(~F.try_element_at("cells", F.lit(1)).isin(*MARKS))
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(line, "cells"))), lambda x: x["cells"]).alias("rows"))


def box_rows(boxes: DataFrame, by: list[str], line_share: float = 0.8, cell_share: float = 1.5) -> DataFrame:
    """boxes: by, x, y (middle), h, text. Lines are chains of boxes whose middles differ little; in a line, boxes whose left edges are near join."""
    boxes = boxes.where(F.trim("text") != "").withColumn("text", F.trim("text"))
    tall = boxes.groupBy(*by).agg(F.sort_array(F.collect_list("h")).alias("hs")).select(*by, F.try_element_at("hs", F.floor(F.size("hs") / 2).cast("int") + 1).alias("m"))
    boxes = boxes.join(tall, by)
    down = Window.partitionBy(*by).orderBy("y", "x")
    lined = boxes.withColumn("line", F.sum(F.when(F.abs(F.col("y") - F.lag("y").over(down)) > line_share * F.col("m"), 1).otherwise(0)).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    right = Window.partitionBy(*by, "line").orderBy("x", "y")
    cells = lined.withColumn("cell", F.sum(F.when(F.col("x") - F.lag("x").over(right) >= cell_share * F.col("m"), 1).otherwise(0)).over(right.rowsBetween(Window.unboundedPreceding, 0)))
    joined = cells.groupBy(*by, "line", "cell").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "y", "text"))), lambda x: x["text"]), " ").alias("text"))
    return _rows(joined, by, "line", "cell")


def _turned(rows: Column) -> Column:
    """Records of rows whose first cells are names."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    names = F.transform(rows, lambda r: F.try_element_at(r, F.lit(1)))
    return F.struct(names.alias("names"), F.when(width > 1, F.transform(F.sequence(F.lit(2), width), lambda c: F.transform(rows, lambda r: F.try_element_at(r, c)))).otherwise(F.array().cast("array<array<string>>")).alias("records"))


def _straight(rows: Column) -> Column:
    """Records below a first row of names, padded and cut to its width."""
    names = F.try_element_at(rows, F.lit(1))
    body = F.slice(rows, 2, F.size(rows))
    return F.struct(names.alias("names"), F.transform(body, lambda r: F.transform(names, lambda _, i: F.try_element_at(r, i + 1))).alias("records"))


def _others(rows: Column) -> Column:
    """Mean number of cells of the columns but the first."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    total = F.aggregate(rows, F.lit(0), lambda a, r: a + F.greatest(F.size(r) - 1, F.lit(0)))
    return F.when(width > 1, total / (width - 1)).otherwise(0.0)


def word_tables(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, table (names, records): rows from the first with three cells on; as records per column where all columns are about as long as the first."""
    first = F.array_position(F.transform("rows", lambda r: F.size(r) >= 3), F.lit(True))
    own = rows.where(first > 0).withColumn("rows", F.slice("rows", first.cast("int"), F.size("rows"))).where(F.size("rows") >= 2)
    turn = (F.size("rows") > 2) & (_others(F.col("rows")) > 0) & (F.abs(F.size("rows") - _others(F.col("rows"))) <= 2)
    return own.select(*by, F.when(turn, _turned(F.col("rows"))).otherwise(_straight(F.col("rows"))).alias("table"))


def box_tables(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, table: as records per column if the first column is longer than the others; else names from the first row with two cells."""
    own = rows.where(F.size("rows") >= 2)
    width = F.array_max(F.transform("rows", lambda r: F.size(r)))
    turn = (width >= 3) & (F.size("rows") >= 3) & (_others(F.col("rows")) >= 1) & (F.size("rows") > _others(F.col("rows")))
    first = F.array_position(F.transform("rows", lambda r: F.size(r) >= 2), F.lit(True))
    # a column of its own, as each record looks up the names in it
    own = own.withColumns({"__below": F.slice("rows", F.greatest(first, F.lit(1)).cast("int"), F.size("rows")), "__first": first, "__turn": turn})
    straight = (F.col("__first") > 0) & (F.size("__below") > 1)
    # the filter is on its conditions: one on the table itself would be moved down and make it once more, record by record
    return own.where(F.col("__turn") | straight).select(*by, F.when(F.col("__turn"), _turned(F.col("rows"))).otherwise(_straight(F.col("__below"))).alias("table"))


def ruled_tables(tables: DataFrame, by: list[str]) -> DataFrame:
    """tables: by, table_idx, rows. The tables of a page as one: later ones without their first row; turned where the first column is over twice as long as the others."""
    joined = tables.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("table_idx", "rows"))).alias("t"))
    rows = F.flatten(F.transform("t", lambda x, i: F.when(i == 0, x["rows"]).otherwise(F.slice(x["rows"], 2, F.size(x["rows"])))))
    own = joined.select(*by, rows.alias("rows"))
    length = F.size(F.filter("rows", lambda r: F.coalesce(F.try_element_at(r, F.lit(1)), F.lit("")) != ""))
    turn = (length > 3) & (length > 2 * _others(F.col("rows")))
    return own.select(*by, F.when(turn, _turned(F.col("rows"))).otherwise(_straight(F.col("rows"))).alias("table"))
