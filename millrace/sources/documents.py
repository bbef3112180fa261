"""Documents (PDF, images) as tables: readers to plug in, tried from cheap to costly, and what becomes of their words and boxes."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.header import unique_names
from ..operators.layout import box_rows, box_tables, ruled_tables, word_rows, word_tables
from .files import BackendMissing

SHEET = "Nội dung"
Reader = Callable[[str, bytes], Iterator[list]]


def first_that_reads(*readers: Reader | None) -> Reader:
    """A reader that asks each given one in turn (text, then OCR, then a model) until one gives rows."""

    def read(path: str, data: bytes) -> Iterator[list]:
        known = [r for r in readers if r is not None]
        for reader in known:
            try:
                rows = list(reader(path, data))
            except Exception:  # noqa: BLE001, S112  the next, costlier one may do
                continue
            if rows:
                yield from rows
                return
        raise BackendMissing(f"no backend installed for {path}") if not known else ValueError(f"no table found in {path}")

    return read


def records_reader(extract: Callable[[str, bytes], str | None]) -> Reader:
    """A reader of a model's reply: a JSON array of objects anywhere in it; the keys of all objects, in order, are the header."""

    def read(path: str, data: bytes) -> Iterator[list]:
        rows = parse_records(extract(path, data) or "")
        names = list(dict.fromkeys(k for r in rows for k in r))
        text = lambda v: None if v is None or v == "" else ("n", str(v), float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else ("s", str(v), None)
        if names:
            yield [("s", n, None) for n in names]
            for r in rows:
                yield [text(r.get(n)) for n in names]

    return read


def parse_records(reply: str) -> list[dict]:
    body = re.search(r"\[.*\]", reply, re.S)
    try:
        data = json.loads(body[0]) if body else []
    except ValueError:
        return []
    return [r for r in data if isinstance(r, dict)] if isinstance(data, list) else []


def boxes_of(result: Sequence[tuple]) -> list[tuple[float, float, float, str]]:
    """x, middle y, height and text of OCR results (four corners, text, confidence); blank ones are left out."""
    out = []
    for corners, text, *_ in result:
        if text and text.strip():
            xs, ys = [p[0] for p in corners], [p[1] for p in corners]
            out.append((float(min(xs)), (min(ys) + max(ys)) / 2.0, float(max(ys) - min(ys)), text.strip()))
    return out


def first_pages(tables: DataFrame) -> DataFrame:
    """source_path, table: of each file the first page that has one."""
    return tables.groupBy("source_path").agg(F.min_by("table", "page").alias("table"))


def word_documents(words: DataFrame) -> DataFrame:
    """words: source_path, page, text, x0, x1, top. The first table of each file."""
    return first_pages(word_tables(word_rows(words, ["source_path", "page"]), ["source_path", "page"]))


def box_documents(boxes: DataFrame) -> DataFrame:
    """boxes: source_path, page, x, y, h, text. One table a page."""
    return box_tables(box_rows(boxes, ["source_path", "page"]), ["source_path", "page"])


def ruled_documents(tables: DataFrame) -> DataFrame:
    """tables: source_path, table_idx, rows. The tables of a file as one."""
    return ruled_tables(tables, ["source_path"])


def table_records(tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records and names, as the pipeline takes them, of tables (source_path, table, and page if there are several); pages of a file follow each other."""
    page = F.col("page") if "page" in tables.columns else F.lit(0)
    own = tables.select("source_path", page.cast("int").alias("page"), unique_names(F.transform("table.names", lambda n: F.coalesce(F.nullif(F.trim(n), F.lit("")), F.lit("Unnamed")))).alias("names"), F.col("table.records").alias("records"))
    # a row's number within its file: the rows of the pages before, then its place
    before = Window.partitionBy("source_path").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("start", F.coalesce(F.sum(F.size("records")).over(before), F.lit(0)))
    rows = own.select("source_path", "start", "names", F.posexplode("records").alias("k", "r"))
    width = F.least(F.size("names"), F.size("r"))
    values = F.map_from_arrays(F.slice("names", 1, width), F.transform(F.slice("r", 1, width), lambda x: F.nullif(F.trim(x), F.lit(""))))
    recs = rows.select("source_path", F.lit(SHEET).alias("sheet"), (F.col("start") + F.col("k")).cast("long").alias("row_idx"), values.alias("values"))
    names = own.groupBy("source_path").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page", "names"))), lambda x: x["names"]))).alias("names"))
    return recs, names.select("source_path", F.lit(SHEET).alias("sheet"), "names", F.lit(0).alias("duplicates"))
