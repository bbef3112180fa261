"""Finding the sheet, the header and the orientation of raw grids.

A grid is a DataFrame: source_path, sheet, row_idx, cells (array of struct kind, s, d): kind `s` text, `n` number, `b` boolean,
`d` date, null for an empty cell; s the cell as text, d its number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

CELL = "struct<kind: string, s: string, d: double>"
GRID = f"source_path string, sheet string, row_idx bigint, cells array<{CELL}>"
HEAD, SCAN = 60, 15
_FILE = ("source_path", "sheet")


def filled(cells: Column) -> Column:
    return F.filter(cells, lambda x: x["s"].isNotNull() & (strip(x["s"]) != ""))


def header_scores(grid: DataFrame, head: int = HEAD) -> DataFrame:
    """Score of each of the first rows as a header: filled, textual and distinct cells, and rows below that look like data."""
    own = filled(F.col("cells"))
    text = F.size(F.filter(own, lambda x: x["kind"] == "s"))
    n = F.size(own)
    rows = grid.where(F.col("row_idx") < head).select(
        *_FILE, "row_idx", n.alias("n"), F.size("cells").alias("width"), F.try_divide(text, n).alias("textual"), F.size(F.array_distinct(F.transform(own, lambda x: strip(x["s"])))).alias("distinct")
    )
    order = Window.partitionBy(*_FILE).orderBy("row_idx")
    bonus = sum((F.when((F.lead("n", k).over(order) > 0) & (F.lead("textual", k).over(order) < 0.85), 10.0).otherwise(0.0) for k in (1, 2)), F.lit(0.0))
    score = F.when(F.col("n") < 2, 0.0).otherwise(30.0 * F.try_divide(F.col("n"), F.col("width")) + 35.0 * F.col("textual") + 25.0 * F.try_divide(F.col("distinct"), F.col("n")) + bonus)
    return rows.select(*_FILE, "row_idx", F.col("n").alias("filled"), score.alias("score"))


def header_rows(grid: DataFrame, scan: int = SCAN) -> DataFrame:
    """source_path, sheet, header_row: the best of the first rows, the earlier one of equals."""
    best = header_scores(grid).where(F.col("row_idx") < scan).groupBy(*_FILE).agg(F.max(F.struct("score", (-F.col("row_idx")).alias("at"))).alias("best"))
    return best.select(*_FILE, (-F.col("best.at")).alias("header_row"), F.col("best.score").alias("score"))


def best_sheets(grid: DataFrame) -> DataFrame:
    """source_path, sheet: of files with several sheets the one with most filled cells (30 count) and a header (counts 20); the first of equals by sheet order (`sheet_idx` if given, else name)."""
    position = F.col("sheet_idx") if "sheet_idx" in grid.columns else F.col("sheet")
    cells = grid.where(F.col("row_idx") < HEAD).groupBy(*_FILE).agg(F.sum(F.size(filled(F.col("cells")))).alias("cells"), F.min(position).alias("position"))
    scored = cells.join(header_rows(grid), list(_FILE)).where("cells > 0").withColumn("value", F.least("cells", F.lit(30)) + F.when(F.col("score") > 55, 20).otherwise(0))
    order = Window.partitionBy("source_path").orderBy(F.desc("value"), "position")
    return scored.withColumn("n", F.row_number().over(order)).where("n = 1").select("source_path", "sheet", "value")


def transposed(grid: DataFrame) -> DataFrame:
    """source_path, sheet, transposed: labels run down the first column. Rows 0 to 2 are tried; numbers to the right, texts below."""
    first = F.try_element_at("cells", F.lit(1))
    rest = filled(F.slice("cells", 2, F.size("cells")))
    has_label = first["s"].isNotNull() & (strip(first["s"]) != "")
    rows = grid.where("row_idx < 14").select(
        *_FILE, "row_idx", F.when(has_label, strip(first["s"])).alias("label"), (first["kind"] == "s").alias("is_text"),
        ((F.size(rest) > 0) & (F.size(F.filter(rest, lambda x: x["kind"].isin("n", "b"))) >= 0.7 * F.size(rest))).alias("numeric"),
    )
    files = rows.groupBy(*_FILE).agg(F.collect_list(F.struct("row_idx", "label", "is_text", "numeric")).alias("r"))

    def test(k: int) -> Column:
        at = F.try_element_at(F.filter("r", lambda x: x["row_idx"] == k), F.lit(1))
        labels = F.filter("r", lambda x: (x["row_idx"] > k) & (x["row_idx"] <= k + 11) & x["label"].isNotNull())
        names = F.array_distinct(F.transform(labels, lambda x: x["label"]))
        return at["label"].isNotNull() & at["is_text"] & at["numeric"] & (F.size(labels) >= 2) & F.forall(labels, lambda x: x["is_text"]) & (F.size(names) >= 2)

    tests = test(0) | test(1) | test(2)
    return files.select(*_FILE, F.coalesce(tests, F.lit(False)).alias("transposed"))


def _once(value: Column, body) -> Column:
    """body(value), value computed once: an expression used within a lambda is else computed for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def _runs(starts: Column, n: Column, run) -> Column:
    """run(start, length) of each run of n places, as one array."""
    return F.flatten(F.transform(starts, lambda p, k: run(p, F.coalesce(F.get(starts, k + 1), n) - p)))


def clean_header(cells: Column) -> Column:
    """Names of header cells: a blank repeats the name to its left; a leading blank is `Unnamed: i`. Linear in the width."""

    def named(own: Column) -> Column:
        size = F.size(own)
        found = F.filter(F.transform(own, lambda x, i: F.when(x != "", i)), lambda i: i.isNotNull())

        def filled_in(at: Column) -> Column:
            # the name to repeat at each place: none before the first
            left = F.concat(F.array_repeat(F.lit(None).cast("string"), F.coalesce(F.get(at, F.lit(0)), size)), _runs(at, size, lambda p, n: F.array_repeat(F.get(own, p), n)))
            return F.transform(F.arrays_zip(own.alias("s"), left.alias("left")), lambda x, i: F.when(x["s"] != "", x["s"]).when(~x["left"].startswith("Unnamed: "), x["left"]).otherwise(F.concat(F.lit("Unnamed: "), i.cast("string"))))

        return _once(found, filled_in)

    return _once(F.transform(cells, lambda x: strip(x["s"])), named)


def unique_names(names: Column) -> Column:
    """Names with ` (2)`, ` (3)` ... behind repeated ones, so that a duplicate header doesn't fail a file. Sorted once, equal names are runs."""

    def numbered(sorted_: Column) -> Column:
        first = F.transform(sorted_, lambda x, p: F.when((p == 0) | ~x["name"].eqNullSafe(F.get(sorted_, p - 1)["name"]), p))

        def back(starts: Column) -> Column:
            count = _runs(starts, F.size(sorted_), lambda p, n: F.sequence(F.lit(1), n))
            own = F.transform(F.arrays_zip(sorted_.alias("x"), count.alias("n")), lambda v: F.struct(v["x"]["i"].alias("i"), F.when(v["n"] > 1, F.concat(v["x"]["name"], F.lit(" ("), v["n"].cast("string"), F.lit(")"))).otherwise(v["x"]["name"]).alias("name")))
            return F.transform(F.sort_array(own), lambda x: x["name"])

        return _once(F.filter(first, lambda p: p.isNotNull()), back)

    return _once(F.sort_array(F.transform(names, lambda x, i: F.struct(x.alias("name"), i.alias("i")))), numbered)


def resolved_headers(grid: DataFrame, header_row: int | None = None, skip_rows: int = 0) -> DataFrame:
    """source_path, sheet, header_row, names, duplicates: a given row, else skipped rows, else the best; a row beyond the head means the first."""
    found = header_rows(grid)
    rows = grid.where(F.col("row_idx") < HEAD).groupBy(*_FILE).agg(F.max("row_idx").alias("last"))
    want = F.lit(header_row) if header_row is not None else F.lit(skip_rows) if skip_rows > 0 else F.col("header_row")
    at = found.join(rows, list(_FILE)).select(*_FILE, F.when(want > F.col("last"), 0).otherwise(want).cast("long").alias("header_row"))
    # a row for each file before names are made: a condition on them would else be tested on every row of the grid, below the join
    heads = grid.join(at, list(_FILE)).where("row_idx = header_row").groupBy(*_FILE, "header_row").agg(F.first("cells").alias("cells"))
    names = heads.select(*_FILE, "header_row", clean_header(F.col("cells")).alias("plain"))
    return names.select(*_FILE, "header_row", unique_names(F.col("plain")).alias("names"), (F.size("plain") - F.size(F.array_distinct("plain"))).alias("duplicates"))


def _valued(names: Column, cells: Column) -> list[Column]:
    """values: a map from name to text; typed: one from name to kind and number of the cells that are no text."""
    width = F.least(F.size(names), F.size(cells))
    names, cells = F.slice(names, 1, width), F.slice(cells, 1, width)
    typed = F.map_filter(F.map_from_arrays(names, F.transform(cells, lambda x: F.struct(x["kind"].alias("kind"), x["d"].alias("d")))), lambda _, x: x["kind"] != "s")
    return [F.map_from_arrays(names, F.transform(cells, lambda x: x["s"])).alias("values"), typed.alias("typed")]


def records(grid: DataFrame, headers: DataFrame) -> DataFrame:
    """source_path, sheet, row_idx (from 0), values, typed (see _valued) for each row below the header, cut to the header's width."""
    rows = grid.join(headers.select(*_FILE, "header_row", "names"), list(_FILE)).where("row_idx > header_row")
    return rows.select(*_FILE, (F.col("row_idx") - F.col("header_row") - 1).alias("row_idx"), *_valued(F.col("names"), F.col("cells")))


def transposed_records(grid: DataFrame) -> DataFrame:
    """Records of transposed grids: the first column holds the names, every other column is a record."""
    cells = grid.select(*_FILE, "row_idx", F.posexplode("cells").alias("col", "cell"))
    names = cells.where("col = 0").groupBy(*_FILE).agg(F.array_sort(F.collect_list(F.struct("row_idx", "cell"))).alias("r"))
    names = names.select(*_FILE, unique_names(clean_header(F.transform("r", lambda x: x["cell"]))).alias("names"))
    body = cells.where("col > 0").groupBy(*_FILE, "col").agg(F.array_sort(F.collect_list(F.struct("row_idx", "cell"))).alias("r"))
    joined = body.join(names, list(_FILE))
    return joined.select(*_FILE, (F.col("col") - 1).cast("long").alias("row_idx"), *_valued(F.col("names"), F.transform("r", lambda x: x["cell"])))


def samples(recs: DataFrame, limit: int = 20, blanks: bool = False) -> DataFrame:
    """source_path, sheet, name, row_idx, value, kind (of a cell that is no text): the first values of each column; blanks: blank
    texts count as values. The window's limit is applied within each partition before the shuffle too."""
    typed = ["typed"] if "typed" in recs.columns else []
    cells = recs.select(*_FILE, "row_idx", *typed, F.explode("values").alias("name", "value")).where(F.col("value").isNotNull() if blanks else F.col("value").isNotNull() & (strip(F.col("value")) != ""))
    kind = F.try_element_at("typed", F.col("name"))["kind"] if typed else F.lit(None).cast("string")
    order = Window.partitionBy(*_FILE, "name").orderBy("row_idx")
    return cells.select(*_FILE, "row_idx", "name", "value", kind.alias("kind")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).drop("n")
