"""Queries over grids, files, pages and documents that are made of whole tables, each with the SQL that computes its result."""

from __future__ import annotations

import csv
import io
import re
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import DoubleType

from ..functions import config as conf
from ..functions import dates, similarity, text
from ..operators import header, layout
from ..operators.matching import greedy, score_pairs
from ..sources import documents, sinks
from ..sources.files import engine, entries, grids
from . import providers, staging, stores
from .catalog import _t, query
from .model import MAPPING, AIConfig, CleanRules, Mapping, Settings, Template, TemplateColumn, load_meta
from .pipeline import read_records, source_columns, standardize

# ---------------------------------------------------------------- grids: a book for each nation's customers

#: Names of the columns of straight sheets; labels of transposed ones.
_HEAD, _LABELS = ("Key", "Name", "Balance", "Segment", "Day"), ("Key", "Balance", "Name", "Segment")
_C = "c AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r, cast(c_custkey AS varchar) AS key, cast(cast(round(c_acctbal * 100) AS bigint) AS varchar) AS bal, cast(36526 + c_custkey % 1000 AS varchar) AS day FROM customer)"
_CELLS = f"""{_C}, k AS (SELECT DISTINCT c_nationkey AS k, 'n' || c_nationkey AS f FROM c),
cells AS (SELECT 'n' || c_nationkey AS source_path, 'Data' AS sheet, 2 + r AS row_idx, unnest([0, 1, 2, 3, 4]) AS col, unnest([key, c_name, bal, c_mktsegment, day]) AS s, unnest([false, true, false, true, false]) AS is_text FROM c WHERE c_nationkey % 5 <> 0
UNION ALL SELECT f, 'Data', x.i, x.col, CASE WHEN x.i = 0 AND x.col = 0 THEN 'REPORT ' || k WHEN x.i = 2 THEN ({list(_HEAD)!r})[x.col + 1] END, true FROM k, (SELECT i, col FROM range(3) a(i), range(5) b(col)) x WHERE k % 5 <> 0
UNION ALL SELECT 'n' || c_nationkey, 'Data', unnest([0, 1, 2, 3]), r, unnest([key, bal, c_name, c_mktsegment]), unnest([false, false, true, true]) FROM c WHERE c_nationkey % 5 = 0
UNION ALL SELECT f, 'Data', unnest([0, 1, 2, 3]), 0, unnest({list(_LABELS)!r}), true FROM k WHERE k % 5 = 0
UNION ALL SELECT f, 'Note', 0, 0, 'x', true FROM k)"""
_SCORES = f"""{_CELLS},
n AS (SELECT source_path, sheet, row_idx, count(s) AS n, count(*) AS width, count(s) FILTER (is_text) / nullif(count(s), 0) AS textual, count(DISTINCT trim(s)) AS d FROM cells GROUP BY ALL),
sc AS (SELECT *, CASE WHEN n < 2 THEN 0.0 ELSE 30.0 * n / width + 35.0 * textual + 25.0 * d / n
  + CASE WHEN lead(n, 1) OVER w > 0 AND lead(textual, 1) OVER w < 0.85 THEN 10 ELSE 0 END + CASE WHEN lead(n, 2) OVER w > 0 AND lead(textual, 2) OVER w < 0.85 THEN 10 ELSE 0 END END::double AS score
  FROM n WHERE row_idx < 60 WINDOW w AS (PARTITION BY source_path, sheet ORDER BY row_idx))"""


def _book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations divisible by five are transposed, the others have a banner, a blank row and a header; each has a second sheet."""
    s = lambda c: F.struct(F.lit("s").alias("kind"), (F.lit(c) if isinstance(c, str) else c).alias("s"), F.lit(None).cast("double").alias("d"))
    n = lambda c: F.struct(F.lit("n").alias("kind"), c.cast("string").alias("s"), c.cast("double").alias("d"))
    none = F.lit(None).cast("struct<kind: string, s: string, d: double>")
    c = _t(spark, sf_dir, "customer").withColumn("r", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")))
    cells = {"Key": n(F.col("c_custkey")), "Name": s(F.col("c_name")), "Balance": n(F.round(F.col("c_acctbal") * 100).cast("long")), "Segment": s(F.col("c_mktsegment")), "Day": n(36526 + F.col("c_custkey") % 1000)}
    path, straight = F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("source_path"), F.col("c_nationkey") % 5 != 0
    named = lambda rows, sheet, i: rows.select("source_path", F.lit(sheet).alias("sheet"), F.lit(i).alias("sheet_idx"), F.col("row_idx").cast("long").alias("row_idx"), F.col("cells").cast(f"array<{header.CELL}>").alias("cells"))
    body = c.where(straight).select(path, (F.col("r") + 2).alias("row_idx"), F.array(*[cells[h] for h in _HEAD]).alias("cells"))
    files = c.select("c_nationkey").distinct()
    top = F.array(F.array(s(F.concat(F.lit("REPORT "), F.col("c_nationkey").cast("string"))), *[none] * 4), F.array(*[none] * 5), F.array(*[s(h) for h in _HEAD]))
    heads = files.where(straight).select(path, F.posexplode(top).alias("row_idx", "cells"))
    across = c.where(~straight).groupBy("c_nationkey").agg(*[F.transform(F.array_sort(F.collect_list(F.struct("r", cells[h].alias("x")))), lambda v: v["x"]).alias(h) for h in _LABELS])
    turned = across.select(path, F.posexplode(F.array(*[F.concat(F.array(s(h)), F.col(h)) for h in _LABELS])).alias("row_idx", "cells"))
    notes = files.select(path, F.lit(0).alias("row_idx"), F.array(s("x")).alias("cells"))
    return named(body, "Data", 0).union(named(heads, "Data", 0)).union(named(turned, "Data", 0)).union(named(notes, "Note", 1))


@query(f"WITH {_SCORES} SELECT source_path, sheet, row_idx::bigint AS row_idx, round(score, 6) AS score FROM sc")
def header_score(spark, sf_dir):
    """Scores of the first rows"""
    return header.header_scores(_book(spark, sf_dir)).select("source_path", "sheet", "row_idx", F.round("score", 6).alias("score"))


@query(f"WITH {_SCORES} SELECT source_path, sheet, arg_max(row_idx, score * 1000 - row_idx)::bigint AS header_row FROM sc WHERE row_idx < 15 GROUP BY ALL")
def header_detect(spark, sf_dir):
    """S7"""
    return header.header_rows(_book(spark, sf_dir)).select("source_path", "sheet", "header_row")


@query(f"""WITH {_SCORES}, f AS (SELECT source_path, sheet, least(count(s), 30) AS cells FROM cells WHERE row_idx < 60 GROUP BY ALL), b AS (SELECT source_path, sheet, max(score) AS best FROM sc WHERE row_idx < 15 GROUP BY ALL)
SELECT source_path, arg_max(sheet, cells + CASE WHEN best > 55 THEN 20 ELSE 0 END) AS sheet, max(cells + CASE WHEN best > 55 THEN 20 ELSE 0 END)::int AS value FROM f JOIN b USING (source_path, sheet) GROUP BY source_path""")
def sheet_pick(spark, sf_dir):
    """S9"""
    return header.best_sheets(_book(spark, sf_dir)).select("source_path", "sheet", F.col("value").cast("int").alias("value"))


@query("SELECT DISTINCT 'n' || c_nationkey AS source_path, unnest(['Data', 'Note']) AS sheet, unnest([c_nationkey % 5 = 0, false]) AS transposed FROM customer")
def transpose_detect(spark, sf_dir):
    """S8"""
    return header.transposed(_book(spark, sf_dir))


@query(f"WITH {_CELLS} SELECT source_path, (b.col - 1)::bigint AS row_idx, a.s AS name, b.s AS value FROM cells a JOIN cells b USING (source_path, sheet, row_idx) WHERE sheet = 'Data' AND cast(source_path[2:] AS int) % 5 = 0 AND a.col = 0 AND b.col > 0")
def transpose(spark, sf_dir):
    """S13"""
    book = _book(spark, sf_dir).where("sheet = 'Data' and cast(substring(source_path, 2) as int) % 5 = 0")
    return header.transposed_records(book).select("source_path", "row_idx", F.explode("values").alias("name", "value"))


@query(f"WITH {_CELLS} SELECT source_path, (b.row_idx - 3)::bigint AS row_idx, a.s AS name, b.s AS value, CASE WHEN b.is_text THEN NULL ELSE 'n' END AS kind FROM cells a JOIN cells b USING (source_path, sheet, col) WHERE sheet = 'Data' AND cast(source_path[2:] AS int) % 5 <> 0 AND a.row_idx = 2 AND b.row_idx > 2")
def read_frame(spark, sf_dir):
    """Records below the found header, with the kind of cells that are no text"""
    book = _book(spark, sf_dir).where("sheet = 'Data' and cast(substring(source_path, 2) as int) % 5 <> 0")
    recs = header.records(book, header.resolved_headers(book))
    return recs.select("source_path", "row_idx", "typed", F.explode("values").alias("name", "value")).select("source_path", "row_idx", "name", "value", F.try_element_at("typed", F.col("name"))["kind"].alias("kind"))


@query(f"WITH {_C} SELECT DISTINCT 'n' || c_nationkey AS source_path, i::int AS pos, CASE WHEN c_nationkey % 5 = 0 THEN ({list(_LABELS)!r})[i + 1] ELSE ({list(_HEAD)!r})[i + 1] END AS name FROM c, range(5) AS x(i) WHERE i < 4 OR c_nationkey % 5 <> 0")
def header_names(spark, sf_dir):
    """Names alone, of straight and transposed sheets"""
    _, names = read_records(staging.materialized(_book(spark, sf_dir), "grid"))
    return names.select("source_path", F.posexplode("names").alias("pos", "name"))


_GAPS = "SELECT o_custkey AS grp, o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN '  ' ELSE ' ' || o_orderpriority END AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders"


@query(f"SELECT grp, i::int AS i, coalesce(nullif(trim(s), ''), last_value(nullif(trim(s), '') IGNORE NULLS) OVER (PARTITION BY grp ORDER BY i), 'Unnamed: ' || i) AS name FROM ({_GAPS})")
def fill_forward_header(spark, sf_dir):
    """Blanks repeat the name to their left"""
    s = F.when(F.col("o_orderkey") % 3 == 0, None).when(F.col("o_orderkey") % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("o_orderpriority")))
    cell = F.when(s.isNotNull(), F.struct(F.lit("s").alias("kind"), s.alias("s"), F.lit(None).cast("double").alias("d")))
    rows = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("grp")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", cell.alias("c")))), lambda x: x["c"]).alias("cells"))
    return rows.select("grp", F.posexplode(header.clean_header(F.col("cells"))).alias("i", "name"))


@query(f"SELECT grp, k, s IS NULL OR trim(s) = '' AS blank FROM ({_GAPS})")
def blank_cells(spark, sf_dir):
    """Null or blank"""
    s = F.when(F.col("o_orderkey") % 3 == 0, None).when(F.col("o_orderkey") % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("o_orderpriority")))
    return _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("k"), text.is_empty(s).alias("blank"))


# ---------------------------------------------------------------- files: workbooks and CSV of each nation's customers

#: Nations divisible by four are workbooks with numbers and date serials, the others CSV files with texts.
_TEMPLATE = Template((TemplateColumn("Mã KH", True, order=0), TemplateColumn("Tên khách", True, order=1), TemplateColumn("Số dư", default=0, data_type="number", order=2), TemplateColumn("Ngày", data_type="date", order=3)), "t.xlsx")
_DAY = "date '1998-01-01' + cast(c_custkey % 1000 AS int)"
_ROWS = f"""c AS (SELECT *, 'n' || c_nationkey || CASE WHEN c_nationkey % 4 = 0 THEN '.xlsx' ELSE '.csv' END AS f, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS r,
  c_nationkey % 4 <> 0 AND c_custkey % 7 = 0 AS bad, c_custkey % 11 = 0 AND NOT (c_nationkey % 4 <> 0 AND c_custkey % 7 = 0) AS gap, cast(round(c_acctbal * 100) AS bigint) / 100.0::double AS bal, {_DAY} AS day FROM customer)"""
_BROKEN = (("broken.xlsx", b"no zip", "failed"), ("old.xls", b"x", "failed"), ("scan.pdf", b"%PDF", "failed"), ("empty.csv", b'"Ma_KH","Ten khach"\n', "failed"), ("void.csv", b"", "failed"), ("note.txt", b"x", "failed"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content. Each workbook and each CSV file is made on the executors, the workbooks by the sink itself."""
    key, cents = F.col("c_custkey"), F.round(F.col("c_acctbal") * 100).cast("long")
    day = F.date_add(F.lit("1998-01-01").cast("date"), (key % 1000).cast("int"))
    c = _t(spark, sf_dir, "customer").withColumn("source_path", F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.when(F.col("c_nationkey") % 4 == 0, ".xlsx").otherwise(".csv")))
    serial = F.datediff(day, F.lit("1899-12-30").cast("date"))
    books = c.where("c_nationkey % 4 = 0").select("source_path", key.alias("row_idx"), key.alias("Ma_KH"), F.concat(F.lit("  "), F.col("c_name")).alias("Ten khach"), F.when(key % 11 != 0, cents / 100.0).alias("So du"), serial.alias("Ngay"), F.lit("x").alias("Phu"))
    made = sinks.write_workbooks(books, ["Ma_KH", "Ten khach", "So du", "Ngay", "Phu"]).withColumnRenamed("source_path", "path")
    whole = F.regexp_replace(F.floor(F.abs(cents) / 100).cast("string"), r"(\d)(?=(\d{3})+$)", "$1.")
    # a comma after a dot is decimal; a comma alone would group thousands
    shown = F.concat(F.when(cents < 0, "-").otherwise(""), whole, F.when(F.abs(cents) >= 100000, ",").otherwise("."), F.lpad((F.abs(cents) % 100).cast("string"), 2, "0"))
    amount = F.when(key % 7 == 0, "?").when(key % 11 == 0, "").otherwise(shown)
    cells = [key.cast("string"), F.concat(F.lit("  "), F.col("c_name")), amount, F.when(key % 2 == 0, F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "dd/MM/yyyy")), F.lit("x")]
    line = F.concat(F.lit('"'), F.concat_ws('","', *cells), F.lit('"'))
    texts = c.where("c_nationkey % 4 <> 0").groupBy("source_path").agg(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), line.alias("x")))), lambda v: v["x"]).alias("lines"))
    head = F.lit('Ma_KH,Ten khach,So du,Ngay,Phu\n')
    return made.union(texts.select(F.col("source_path").alias("path"), F.encode(F.concat(head, F.array_join("lines", "\n")), "utf-8").alias("content")))


def _standardized(spark, sf_dir, **options):
    return standardize(_files(spark, sf_dir), options.pop("template", _TEMPLATE), **options)


@query(f"""WITH {_ROWS} SELECT f AS source_path, r::bigint AS row_idx, cast(c_custkey AS varchar) AS "Mã KH", c_name AS "Tên khách",
CASE WHEN bad THEN '?' WHEN gap THEN '0.0' ELSE cast(bal AS varchar) END AS "Số dư", strftime(day, '%d/%m/%Y') AS "Ngày" FROM c""")
def standard_table(spark, sf_dir):
    """Files of two formats, typed cells and texts alike, to one table"""
    return _standardized(spark, sf_dir).table


@query(f"""WITH {_ROWS} SELECT f AS source_path, r + 2 AS row, 'Số dư' AS "column", 'error' AS severity, 'bad_format' AS type, '?' AS value FROM c WHERE bad
UNION ALL SELECT f, r + 2, 'Số dư', 'warning', 'missing_value', '0' FROM c WHERE gap
UNION ALL SELECT DISTINCT f, 0, 'Phu', 'warning', 'extra_column', NULL FROM c
UNION ALL SELECT DISTINCT f, 0, 'Www', 'error', 'unmapped_column', NULL FROM c""")
def standard_issues(spark, sf_dir):
    """A1, M8: the issue log of all files, with the mapping's own issues"""
    return _standardized(spark, sf_dir, template=Template((*_TEMPLATE.columns, TemplateColumn("Www", order=4)))).issues.select("source_path", "row", "column", "severity", "type", "value")


@query(f"""WITH {_ROWS} SELECT f AS source_path, count(*) AS row_count, 4 AS mapped_columns, count(*) FILTER (bad) AS error_count, 1 + count(*) FILTER (gap) AS warning_count, CASE WHEN count(*) FILTER (bad) = 0 THEN 'ok' ELSE 'partial' END AS status FROM c GROUP BY f
UNION ALL SELECT p, 0, 0, 0, 0, 'failed' FROM (VALUES {", ".join(f"('{p}')" for p, *_ in _BROKEN)}) AS v(p)""")
def standard_reports(spark, sf_dir):
    """Files that can't be read, hold no data, or have no backend are failed reports"""
    more = spark.createDataFrame([(p, bytearray(b)) for p, b, _ in _BROKEN], "path string, content binary")
    found = standardize(_files(spark, sf_dir).union(more), _TEMPLATE).reports
    return found.select("source_path", "row_count", "mapped_columns", "error_count", "warning_count", "status")


_EACH = "(SELECT DISTINCT 'n' || c_nationkey || CASE WHEN c_nationkey % 4 = 0 THEN '.xlsx' ELSE '.csv' END AS f FROM customer)"


@query(f"""SELECT f AS "group", t AS template_col, s AS source_col, m AS match_source, c::double AS confidence FROM {_EACH}, (VALUES ('Mã KH', 'Ma_KH', 'exact', 100), ('Tên khách', 'Ten khach', 'exact', 100), ('Số dư', 'So du', 'exact', 100), ('Công nợ', 'Phu', 'synonym', 100), ('Ngày', 'Ngay', 'exact', 100)) AS v(t, s, m, c)""")
def standard_mappings(spark, sf_dir):
    """M5 to M7: exact names and a learnt synonym in every file"""
    template = Template((*_TEMPLATE.columns[:3], TemplateColumn("Công nợ", order=3), TemplateColumn("Ngày", data_type="date", order=4)))
    synonyms = spark.createDataFrame([("Công nợ", "phu")], stores.SYNONYMS)
    return _standardized(spark, sf_dir, template=template, synonyms=synonyms).mappings.select("group", F.inline("mappings"))


@query(f"""SELECT f AS "group", t AS template_col, s AS source_col, m AS match_source, c::double AS confidence FROM {_EACH}, (VALUES ('Mã KH', 'Ma_KH', 'exact', 100), ('Xyz', 'Phu', 'ai', 90), ('Ngày', 'Ngay', 'exact', 100), ('Www', NULL, 'unmapped', 0)) AS v(t, s, m, c)""")
def suggested_mappings(spark, sf_dir):
    """A provider is asked for what names leave open; unknown names in its reply don't count"""
    template = Template((TemplateColumn("Mã KH", order=0), TemplateColumn("Xyz", order=1), TemplateColumn("Ngày", data_type="date", order=2), TemplateColumn("Www", order=3)))
    suggester = providers.CachedSuggester(AIConfig(enabled=True, api_key="k", model="m"), lambda t, s: 'Sure: {"Xyz": "Phu", "Www": "none", "Q": "Phu"}.')
    return _standardized(spark, sf_dir, template=template, suggester=suggester).mappings.select("group", F.inline("mappings"))


@query(f"""SELECT f AS "group", t AS template_col, s AS source_col, m AS match_source, c::double AS confidence FROM {_EACH}, (VALUES ('Mã KH', 'Ma_KH', 'manual', 100), ('Tên khách', NULL, 'unmapped', 0), ('Số dư', 'So du', 'manual', 100), ('Ngày', NULL, 'unmapped', 0)) AS v(t, s, m, c)""")
def overridden_mappings(spark, sf_dir):
    """P5: given mappings; a source that a file hasn't got is unmapped"""
    given = [Mapping("Mã KH", "Ma_KH", "manual", 100.0), Mapping("Tên khách", "nowhere", "manual", 100.0), Mapping("Số dư", "So du", "manual", 100.0), Mapping("Ngày", None, "unmapped", 0.0)]
    return _standardized(spark, sf_dir, override=given).mappings.select("group", F.inline("mappings"))


@query(f"SELECT f AS source_path, CASE WHEN f LIKE '%.xlsx' THEN 'Sheet1' ELSE 'CSV' END AS sheet, 0 AS sheet_idx, n AS n_rows FROM (SELECT 'n' || c_nationkey || CASE WHEN c_nationkey % 4 = 0 THEN '.xlsx' ELSE '.csv' END AS f, count(*) + 1 AS n FROM customer GROUP BY 1)")
def file_sheets(spark, sf_dir):
    """Sheets of each file and their rows"""
    return grids(_files(spark, sf_dir)).groupBy("source_path", "sheet", "sheet_idx").agg(F.count("*").alias("n_rows"))


@query(f"""WITH {_ROWS}, seen AS (SELECT f, r, CASE WHEN bad THEN 'text' ELSE 'number' END AS t FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY r) AS m FROM c WHERE NOT gap) WHERE m <= 20),
votes AS (SELECT f, t, count(*) AS n, min(r) AS first FROM seen GROUP BY ALL), best AS (SELECT f, arg_max(t, n * 1000000 - first) AS t, max(n) AS n, sum(n) AS total FROM votes GROUP BY f)
SELECT f AS "group", i::int AS s_pos, ({['Ma_KH', 'Ten khach', 'So du', 'Ngay', 'Phu']!r})[i + 1] AS source_col, CASE i WHEN 0 THEN 'number' WHEN 1 THEN 'text' WHEN 2 THEN CASE WHEN n >= greatest(2, total * 0.5) THEN t ELSE 'unknown' END WHEN 3 THEN CASE WHEN f LIKE '%.xlsx' THEN 'number' ELSE 'date' END ELSE 'code' END AS inferred FROM best, range(5) AS x(i)""")
def typed_columns(spark, sf_dir):
    """Types of each file's columns; a typed number is a number, whatever date its digits would make"""
    recs, names = read_records(grids(_files(spark, sf_dir)))
    return source_columns(recs, names).select("group", "s_pos", "source_col", "inferred")


@query(f"WITH {_ROWS} SELECT c_custkey, strftime(day, '%d/%m/%Y') AS of_number, cast(NULL AS varchar) AS of_boolean, (36526 + c_custkey)::double AS number, cast(NULL AS double) AS boolean_number, 'number' AS number_type, 'unknown' AS boolean_type FROM c")
def typed_cells(spark, sf_dir):
    """A number is a date by its days and a number as it is; a boolean is neither"""
    from ..functions.infer import classify
    from ..operators.clean import clean_cell

    key = F.col("c_custkey")
    cell = lambda kind, d: F.struct(F.lit(kind).alias("kind"), d.cast("double").alias("d"))
    serial, rules = F.datediff(F.date_add(F.lit("1998-01-01").cast("date"), (key % 1000).cast("int")), F.lit("1899-12-30").cast("date")), CleanRules()
    return _t(spark, sf_dir, "customer").select(
        "c_custkey", clean_cell(serial.cast("string"), "date", rules, cell("n", serial)).alias("of_number"), clean_cell(F.lit("True"), "date", rules, cell("b", F.lit(1))).alias("of_boolean"),
        clean_cell(F.lit("seen"), "number", rules, cell("n", 36526 + key)).alias("number"), clean_cell(F.lit("1"), "number", rules, cell("b", F.lit(1))).alias("boolean_number"),
        classify(F.lit("20200101"), F.lit("n")).alias("number_type"), classify(F.lit("True"), F.lit("b")).alias("boolean_type"),
    )


@query(f"WITH {_ROWS} SELECT f AS source_path, cast(c_custkey AS varchar) AS key, c_name AS name, CASE WHEN NOT gap AND NOT bad THEN bal END AS value FROM c WHERE c_nationkey % 4 = 0")
def workbook_round_trip(spark, sf_dir):
    """K1: what the workbook sink writes is read back, numbers as numbers"""
    recs, _ = read_records(grids(_files(spark, sf_dir).where("path like '%.xlsx'")))
    return recs.select("source_path", F.col("values")["Ma_KH"].alias("key"), F.trim(F.col("values")["Ten khach"]).alias("name"), F.try_element_at("typed", F.lit("So du"))["d"].alias("value"))


@query("SELECT o_orderkey + 2 AS \"Dòng\", 'total' AS \"Cột\", 'error' AS \"Mức độ\", 'bad_format' AS \"Loại\", 'say \"no\", ' || o_orderpriority AS \"Chi tiết\" FROM orders WHERE o_orderkey % 7 = 0")
def issue_export(spark, sf_dir):
    """K2: the issue log as CSV with a byte order mark, read back"""
    issues = _t(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").select((F.col("o_orderkey") + 2).alias("row"), F.lit("total").alias("column"), F.lit("error").alias("severity"), F.lit("bad_format").alias("type"), F.concat(F.lit('say "no", '), F.col("o_orderpriority")).alias("message"))
    first, *rest = csv.reader(io.StringIO(sinks.issue_csv(issues).decode("utf-8-sig"), newline=""))
    return spark.createDataFrame([(int(r[0]), *r[1:]) for r in rest], f"`{first[0]}` long, " + ", ".join(f"`{c}` string" for c in first[1:]))


def _driver_folder(spark: SparkSession) -> Path:
    """The shared folder as the driver, which reads sidecars and settings itself, sees it."""
    at = Path(re.sub("^file:/+", "/", staging.folder(spark)))
    at.mkdir(parents=True, exist_ok=True)
    return at


@query("""SELECT (ordinal_position - 1)::int AS pos, column_name AS name, column_name LIKE '%key' AS required, CASE WHEN data_type = 'DOUBLE' THEN '0' END AS "default", CASE WHEN data_type = 'DOUBLE' THEN 'number' END AS data_type FROM (SELECT *, row_number() OVER (ORDER BY column_index) AS ordinal_position FROM duckdb_columns() WHERE table_name = 'customer')""")
def template_sidecar(spark, sf_dir):
    """A template from a file's header with what its sidecar adds"""
    schema = _t(spark, sf_dir, "customer").schema
    path = f"{_driver_folder(spark)}/template-{id(schema)}.csv"
    spark.createDataFrame([(",".join(schema.names),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    part = spark.read.format("binaryFile").load(path).select("path").first().path
    columns = tuple(TemplateColumn(f.name, f.name.endswith("key"), 0 if f.dataType.simpleString() == "double" else None, "number" if f.dataType.simpleString() == "double" else None, i) for i, f in enumerate(schema))
    Template(columns).save_meta(path)
    names = grids(spark.read.format("binaryFile").load(path).withColumn("path", F.lit("t.csv"))).where("row_idx = 0").select(header.clean_header(F.col("cells")).alias("names")).first().names
    template = Template(tuple(TemplateColumn(n, order=i) for i, n in enumerate(names)), part).with_meta(load_meta(path))
    return spark.createDataFrame([(c.order, c.name, c.name in template.required, None if c.default is None else str(c.default), c.data_type) for c in template.columns], "pos int, name string, required boolean, default string, data_type string")


@query("SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations']) AS name")
def file_discovery(spark, sf_dir):
    """Files of a folder by extension, each once, also where a table is a folder of part files"""
    return entries(spark, sf_dir, kinds=("parquet",)).select(F.regexp_extract("path", r"([^/]+)\.parquet$", 1).alias("name"))


_KINDS = ("xlsx", "XLSM", "xls", "csv", "pdf", "JPG", "webp", "txt", "")


@query(f"""SELECT o_orderkey, CASE e WHEN 'xlsx' THEN 'workbook' WHEN 'XLSM' THEN 'workbook' WHEN 'xls' THEN 'legacy' WHEN 'csv' THEN 'csv' WHEN 'txt' THEN NULL WHEN '' THEN NULL ELSE 'document' END AS how FROM (SELECT o_orderkey, ({list(_KINDS)!r})[o_orderkey % {len(_KINDS)} + 1] AS e FROM orders)""")
def file_kinds(spark, sf_dir):
    """How a path is read"""
    e = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("o_orderkey") % len(_KINDS) + 1).cast("int"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", engine(F.concat(F.lit("a.b/c d."), e)).alias("how"))


# ---------------------------------------------------------------- pages: a page for each region's nations

_N = "n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r, count(*) OVER (PARTITION BY n_regionkey) AS m FROM nation)"


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "nation").withColumn("r", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title, then a line for each nation: key, two words of its name, its place. On odd regions only three lines are whole."""
    word = lambda text, x: F.struct(text.cast("string").alias("text"), F.lit(float(x)).alias("x0"), F.lit(float(x + 30)).alias("x1"))
    whole = (F.col("n_regionkey") % 2 == 0) | (F.col("r") <= 2)
    own = F.array(word(F.col("n_nationkey"), 0), *[F.when(whole, word(t, x)) for t, x in ((F.split("n_name", "_")[0], 100), (F.split("n_name", "_")[1], 135), (F.col("r"), 300))])
    lines = _nations(spark, sf_dir).select(F.col("n_regionkey").alias("page"), F.explode(F.array_compact(own)).alias("w"), (F.col("r") * 20.0 + 2).alias("top"))
    title = _t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("page"), word(F.lit("Page"), 0).alias("w"), F.lit(1.0).alias("top"))
    return lines.union(title).select("page", "w.*", "top")


@query(f"""WITH {_N} SELECT n_regionkey AS page, (r - 1)::int AS row, i::int AS cell, CASE i WHEN 0 THEN cast(n_nationkey AS varchar) WHEN 1 THEN replace(n_name, '_', ' ') ELSE cast(r AS varchar) END AS text FROM n, range(3) AS x(i) WHERE i = 0 OR n_regionkey % 2 = 0 OR r <= 2""")
def word_cells(spark, sf_dir):
    """D3: words of a line to cells; a page mark is no row"""
    rows = layout.word_rows(_words(spark, sf_dir), ["page"])
    return rows.select("page", F.posexplode("rows").alias("row", "cells")).select("page", "row", F.posexplode("cells").alias("cell", "text"))


def _exploded(tables: DataFrame, by: str) -> DataFrame:
    rows = tables.select(by, "table.names", F.posexplode("table.records").alias("record", "r"))
    return rows.select(by, "record", F.posexplode("r").alias("pos", "value"), "names").select(by, "record", "pos", F.element_at("names", F.col("pos") + 1).alias("name"), "value")


@query(f"""WITH {_N} SELECT n_regionkey AS page, i::int AS record, (r - 1)::int AS pos, cast(n_nationkey AS varchar) AS name, CASE i WHEN 0 THEN replace(n_name, '_', ' ') ELSE cast(r AS varchar) END AS value FROM n, range(2) AS x(i) WHERE n_regionkey % 2 = 0
UNION ALL SELECT b.n_regionkey, b.r - 2, i, CASE i WHEN 0 THEN cast(a.n_nationkey AS varchar) WHEN 1 THEN replace(a.n_name, '_', ' ') ELSE '1' END, CASE WHEN i = 0 THEN cast(b.n_nationkey AS varchar) WHEN b.r > 2 THEN NULL WHEN i = 1 THEN replace(b.n_name, '_', ' ') ELSE cast(b.r AS varchar) END
FROM n a JOIN n b USING (n_regionkey), range(3) AS x(i) WHERE n_regionkey % 2 = 1 AND a.r = 1 AND b.r > 1""")
def word_table_records(spark, sf_dir):
    """Tables of words, turned where the columns are as long as the first, else straight, padded to the names"""
    return _exploded(layout.word_tables(layout.word_rows(_words(spark, sf_dir), ["page"]), ["page"]), "page")


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header and a box or two for each value; names are two boxes that stand close."""
    box = lambda text, x: F.struct(text.cast("string").alias("text"), F.lit(float(x)).alias("x"))
    lines = _nations(spark, sf_dir).select(F.col("n_regionkey").alias("page"), F.explode(F.array(box(F.col("n_nationkey"), 0), box(F.concat(F.lit(" "), F.split("n_name", "_")[0]), 100), box(F.split("n_name", "_")[1], 125), box(F.col("r"), 200), box(F.lit("  "), 250))).alias("b"), (F.col("r") * 40.0 + (F.col("n_nationkey") % 3)).alias("y"))
    heads = _t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("page"), F.explode(F.array(box(F.lit("Key"), 0), box(F.lit("Name"), 100), box(F.lit("Place"), 200))).alias("b"), F.lit(0.0).alias("y"))
    return lines.union(heads).select("page", "b.*", "y", F.lit(20.0).alias("h"))


@query(f"""WITH {_N} SELECT n_regionkey AS page, r AS line, i AS cell, CASE i WHEN 0 THEN cast(n_nationkey AS varchar) WHEN 1 THEN replace(n_name, '_', ' ') ELSE cast(r AS varchar) END AS text FROM n, range(3) AS x(i)
UNION ALL SELECT r_regionkey, 0, i, (['Key', 'Name', 'Place'])[i + 1] FROM region, range(3) AS x(i)""")
def ocr_rows(spark, sf_dir):
    """Boxes to lines and cells"""
    rows = layout.box_rows(_boxes(spark, sf_dir), ["page"]).select("page", F.posexplode("rows").alias("line", "cells"))
    return rows.select("page", F.col("line").cast("long").alias("line"), F.posexplode("cells").alias("cell", "text")).withColumn("cell", F.col("cell").cast("long"))


@query(f"WITH {_N} SELECT n_regionkey AS page, (r - 1)::int AS record, i::int AS pos, (['Key', 'Name', 'Place'])[i + 1] AS name, CASE i WHEN 0 THEN cast(n_nationkey AS varchar) WHEN 1 THEN replace(n_name, '_', ' ') ELSE cast(r AS varchar) END AS value FROM n, range(3) AS x(i)")
def ocr_table_records(spark, sf_dir):
    """A table of boxes below its header"""
    return _exploded(layout.box_tables(layout.box_rows(_boxes(spark, sf_dir), ["page"]), ["page"]), "page")


@query(f"WITH {_N} SELECT n_regionkey AS page, (r - 1)::int AS record, i::int AS pos, (['Key', 'Name'])[i + 1] AS name, CASE i WHEN 0 THEN cast(n_nationkey AS varchar) ELSE n_name END AS value FROM n, range(2) AS x(i)")
def ruled_table_records(spark, sf_dir):
    """The tables of a page as one; later ones without their first row"""
    rows = _nations(spark, sf_dir).select(F.col("n_regionkey").alias("page"), F.when(F.col("r") <= 2, 0).otherwise(1).alias("table_idx"), "r", F.array(F.col("n_nationkey").cast("string"), "n_name").alias("cells"))
    parts = rows.groupBy("page", "table_idx").agg(F.concat(F.array(F.array(F.lit("Key"), F.lit("Name"))), F.transform(F.array_sort(F.collect_list(F.struct("r", "cells"))), lambda x: x["cells"])).alias("rows"))
    return _exploded(layout.ruled_tables(parts, ["page"]), "page")


@query(f"WITH {_N} SELECT 'r' || n_regionkey || '.pdf' AS source_path, r - 1 AS row_idx, name, value FROM (SELECT n_regionkey, r, unnest(['key', 'name', 'none']) AS name, unnest([cast(n_nationkey AS varchar), n_name, NULL]) AS value FROM n)")
def document_records(spark, sf_dir):
    """Documents by the first reader that gives rows: one that fails, one that finds nothing, a model's JSON in prose"""

    def broken(path, data):
        raise OSError(path)

    rows = _nations(spark, sf_dir).groupBy("n_regionkey").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("r", F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")))), lambda x: F.struct(x["key"].alias("key"), x["name"].alias("name"), F.lit("").alias("none")))).alias("j"))
    files = rows.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit(".pdf")).alias("path"), F.encode(F.concat(F.lit("Here you are: "), F.col("j"), F.lit(" - done")), "utf-8").alias("content"))
    read = documents.first_that_reads(None, broken, lambda path, data: iter([]), documents.records_reader(lambda path, data: data.decode()))
    recs, _ = read_records(grids(files, documents=read))
    return recs.select("source_path", "row_idx", F.explode("values").alias("name", "value"))


# ---------------------------------------------------------------- names of parts against each other

_LCS = """p AS (SELECT DISTINCT p_name AS x FROM part), pairs AS (SELECT a.x AS a, b.x AS b FROM p a, p b),
parts AS (SELECT a, b, list_sort(list_distinct(list_filter(string_split(a, ' '), lambda x: x <> ''))) AS ta, list_sort(list_distinct(list_filter(string_split(b, ' '), lambda x: x <> ''))) AS tb FROM pairs),
sets AS (SELECT a, b, array_to_string(list_sort(string_split(a, ' ')), ' ') AS sa, array_to_string(list_sort(string_split(b, ' ')), ' ') AS sb, array_to_string(list_filter(ta, lambda x: list_contains(tb, x)), ' ') AS shared,
  array_to_string(list_filter(ta, lambda x: NOT list_contains(tb, x)), ' ') AS la, array_to_string(list_filter(tb, lambda x: NOT list_contains(ta, x)), ' ') AS lb, len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))) * 100.0 AS overlap FROM parts),
strs AS (SELECT a AS u, b AS v FROM sets UNION SELECT sa, sb FROM sets UNION SELECT la, lb FROM sets),
walk AS (SELECT u, v, 0 AS i, list_transform(range(0, len(v) + 1), lambda j: 0) AS row FROM strs
  UNION ALL SELECT u, v, i + 1, list_reduce(range(0, len(v) + 1), lambda acc, j: CASE WHEN j = 0 THEN acc ELSE list_append(acc, greatest(acc[j], row[j + 1], CASE WHEN u[i + 1] = v[j] THEN row[j] + 1 ELSE 0 END)) END, [0]::INTEGER[]) FROM walk WHERE i < len(u)),
lcs AS (SELECT u, v, row[len(v) + 1] AS n FROM walk WHERE i = len(u)),
r AS (SELECT a, b, overlap, shared, la, lb, 200.0 * x.n / (len(a) + len(b)) AS plain, 200.0 * y.n / (len(sa) + len(sb)) AS sorted, z.n AS common, CASE WHEN shared = '' THEN 0 ELSE 1 END AS gap
  FROM sets JOIN lcs x ON x.u = a AND x.v = b JOIN lcs y ON y.u = sa AND y.v = sb JOIN lcs z ON z.u = la AND z.v = lb),
q AS (SELECT *, len(shared) + gap + len(la) AS na, len(shared) + gap + len(lb) AS nb FROM r),
s AS (SELECT a, b, overlap, plain, sorted, CASE WHEN shared <> '' AND (la = '' OR lb = '') THEN 100.0 ELSE greatest(100.0 * (1 - (len(la) + len(lb) - 2 * common) / (na + nb)), CASE WHEN shared = '' THEN 0 ELSE 100.0 * (1 - (gap + len(la)) / (len(shared) + na)) END, CASE WHEN shared = '' THEN 0 ELSE 100.0 * (1 - (gap + len(lb)) / (len(shared) + nb)) END) END AS sets FROM q)"""


def _part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of the distinct names, as many as a vocabulary of names has (64 of two words)."""
    names = _t(spark, sf_dir, "part").select("p_name").distinct()
    return names.select(F.col("p_name").alias("a")).crossJoin(names.select(F.col("p_name").alias("b")))


@F.pandas_udf(DoubleType())
def _sorted_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity.sort_ratio(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(DoubleType())
def _set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity.set_ratio(x, y) for x, y in zip(a, b, strict=True)])


@query(f"WITH RECURSIVE {_LCS} SELECT a, b, round(plain, 6)::double AS plain, round(sorted, 6)::double AS sorted, round(sets, 6)::double AS sets, round(greatest(plain, sorted, sets), 6)::double AS best, round(overlap, 6)::double AS overlap FROM s")
def name_score(spark, sf_dir):
    """The three ratios, the best of them, the overlap of tokens"""
    a, b = F.col("a"), F.col("b")
    return _part_pairs(spark, sf_dir).select("a", "b", F.round(similarity.indel_ratio(a, b), 6).alias("plain"), F.round(_sorted_ratio(a, b), 6).alias("sorted"), F.round(_set_ratio(a, b), 6).alias("sets"), F.round(similarity.name_score(a, b), 6).alias("best"), F.round(similarity.token_overlap(a, b), 6).alias("overlap"))


@query(f"""WITH RECURSIVE {_LCS} SELECT a AS template_col, b AS source_col, round(CASE WHEN a = 'small ring' AND b = 'red bolt' THEN 100.0 ELSE greatest(0.0, least(100.0, 0.55 * greatest(plain, sorted, sets) + 0.30 * overlap + CASE WHEN b LIKE 'red %' THEN -12.0 WHEN b LIKE 'hot %' THEN 0.0 ELSE 15.0 END)) END, 6)::double AS score FROM s""")
def pair_scores(spark, sf_dir):
    """M4, M5: names, tokens, types and a synonym of every pair of columns"""
    names = _t(spark, sf_dir, "part").select("p_name").distinct()
    template = names.select(F.col("p_name").alias("template_col"), F.lit("text").alias("data_type"), F.lit(0).alias("t_pos"))
    sources = names.select(F.lit("f").alias("group"), F.col("p_name").alias("source_col"), F.when(F.col("p_name").startswith("red "), "date").when(F.col("p_name").startswith("hot "), "unknown").otherwise("code").alias("inferred"), F.lit(0).alias("s_pos"))
    synonyms = spark.createDataFrame([("small ring", "red bolt")], stores.SYNONYMS)
    return score_pairs(template, sources, synonyms).select("template_col", "source_col", F.round("score", 6).alias("score"))


_TAKEN = f"""{_LCS}, t AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i FROM p WHERE x NOT LIKE 'red %' AND x NOT LIKE 'hot %'), c AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS j FROM p WHERE x LIKE 'red %' OR x LIKE 'hot %'),
cand AS (SELECT t.i, t.x AS template_col, c.j, c.x AS source_col, greatest(0.0, least(100.0, 0.55 * greatest(plain, sorted, sets) + 0.30 * overlap + CASE WHEN c.x LIKE 'red %' THEN 15.0 ELSE 0.0 END)) AS score FROM t, c, s WHERE s.a = t.x AND s.b = c.x),
g AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS used, '' AS template_col, NULL::VARCHAR AS source_col, 0.0::DOUBLE AS confidence
  UNION ALL SELECT i + 1, CASE WHEN top >= 35 THEN list_append(used, src) ELSE used END, col, CASE WHEN top >= 35 THEN src END, CASE WHEN top >= 35 THEN round(top, 1) ELSE 0.0 END
  FROM (SELECT g.i, used, any_value(t.x) AS col, max(score) AS top, arg_max(cand.source_col, round(score * 1000000) * 1000 - j) AS src FROM g JOIN t ON t.i = g.i LEFT JOIN cand ON cand.i = g.i AND NOT list_contains(used, cand.source_col) GROUP BY g.i, used))"""


@query(f"WITH RECURSIVE {_TAKEN} SELECT template_col, source_col, CASE WHEN source_col IS NULL THEN 'unmapped' ELSE 'fuzzy' END AS match_source, confidence FROM g WHERE i > 0")
def greedy_mapping(spark, sf_dir):
    """M6: columns in order take the best source that is left; a source is used once, also where a later column would like it"""
    names = _t(spark, sf_dir, "part").select("p_name").distinct()
    order = F.row_number().over(Window.orderBy("p_name")) - 1  # the vocabulary's 64 names
    source = F.col("p_name").rlike("^(red|hot) ")
    template = names.where(~source).select(F.col("p_name").alias("template_col"), F.lit("text").alias("data_type"), order.alias("t_pos"))
    sources = names.where(source).select(F.lit("f").alias("group"), F.col("p_name").alias("source_col"), F.when(F.col("p_name").startswith("red "), "code").otherwise("unknown").alias("inferred"), order.alias("s_pos"))
    return greedy(score_pairs(template, sources), 35.0).select(F.inline("mappings"))


# ---------------------------------------------------------------- dates beyond the listed ways, settings, stores, providers

_LONG = ("%d %B %Y", "%Y-%m-%dT%H:%M:%SZ", "%Y", "%m-%d-%Y", "%H:%M", "today")


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN date_trunc('day', o_orderdate) WHEN 1 THEN date_trunc('second', o_orderdate) WHEN 2 THEN date_trunc('year', o_orderdate)::timestamp
WHEN 3 THEN coalesce(try_strptime(strftime(o_orderdate, '%m-%d-%Y'), '%d-%m-%Y'), date_trunc('day', o_orderdate)) END::timestamp AS parsed FROM orders""")
def date_fallback(spark, sf_dir):
    """Months in full, ISO with a zone, years alone, month first; what would mean today is no date"""
    at, key = F.col("o_orderdate"), F.col("o_orderkey") % 6
    s = F.when(key == 0, F.date_format(at, "d MMMM yyyy")).when(key == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(key == 2, F.date_format(at, "yyyy")).when(key == 3, F.date_format(at, "MM-dd-yyyy")).when(key == 4, F.date_format(at, "HH:mm")).otherwise("today")
    return _t(spark, sf_dir, "orders").select("o_orderkey", dates.parse_date(s).alias("parsed"))


@query("SELECT event_id, CASE event_id % 3 WHEN 2 THEN 'https://host.example/v' || event_id ELSE 'http://127.0.0.1:20128/v1' END AS url FROM events")
def base_urls(spark, sf_dir):
    """K6, K9: any spelling of the local endpoint is the platform's default"""
    e = _t(spark, sf_dir, "events")
    url = F.when(F.col("event_id") % 3 == 0, "http://localhost:20128/v1/").when(F.col("event_id") % 3 == 1, "http://127.0.0.1:20128/v1").otherwise(F.concat(F.lit("https://host.example/v"), F.col("event_id").cast("string")))
    return e.select("event_id", conf.canonical_url(url, ["http://localhost:20128/v1", providers.LOCAL_URL], providers.LOCAL_URL).alias("url"))


@query("SELECT n_nationkey::double AS fuzzy_threshold, n_name AS model, n_nationkey % 2 = 0 AS trim, n_nationkey AS skip FROM nation")
def settings_round_trip(spark, sf_dir):
    """K4: settings are saved and loaded in full"""
    at, out = _driver_folder(spark), []
    for r in _t(spark, sf_dir, "nation").collect():  # a handful of settings files
        Settings(AIConfig(model=r.n_name), CleanRules(trim=r.n_nationkey % 2 == 0), float(r.n_nationkey), None, r.n_nationkey).save(at / "settings.json")
        s = Settings.load(at / "settings.json")
        out.append((s.fuzzy_threshold, s.ai.model, s.clean.trim, s.default_skip_rows))
    return spark.createDataFrame(out, "fuzzy_threshold double, model string, trim boolean, skip int")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 5 < 4 THEN n_name END AS source FROM nation")
def reply_pairs(spark, sf_dir):
    """A provider's reply as JSON in prose, as numbered lines, as quoted prose, as an arrow, as nothing"""
    ways = ('Sure: {{"T": "{0}", "U": "{0}"}}.', "1. T [text] -> {0} [code]\n2. V -> {0}", 'T: the source has "{0} [code]", it fits', "- T => {0},", "Nothing matches {0}")
    rows = _t(spark, sf_dir, "nation").collect()  # one reply each
    found = [(r.n_nationkey, (providers.parse_reply(ways[r.n_nationkey % 5].format(r.n_name), ["T", "W"], [r.n_name]) or {}).get("T")) for r in rows]
    return spark.createDataFrame(found, "n_nationkey int, source string")


@query("SELECT c_nationkey, count(DISTINCT c_custkey % 97) = count(*) AS valid FROM customer GROUP BY c_nationkey")
def manual_mapping(spark, sf_dir):
    """No source column is used twice"""
    one = F.struct(F.lit("t").alias("template_col"), F.concat(F.lit("s"), (F.col("c_custkey") % 97).cast("string")).alias("source_col"), F.lit("manual").alias("match_source"), F.lit(100.0).alias("confidence"))
    return _t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.collect_list(one).cast(f"array<{MAPPING}>").alias("m")).select("c_nationkey", stores.valid_manual(F.col("m")).alias("valid"))


@query("""SELECT DISTINCT 't' || n_regionkey AS template_col, CASE WHEN n_nationkey % 3 = 0 THEN 'known' ELSE lower(replace(n_name, '_', ' ')) END AS alias FROM nation WHERE n_nationkey % 3 <> 1""")
def synonym_store(spark, sf_dir):
    """Changed pairs are learnt in normal form, each once"""
    n = _t(spark, sf_dir, "nation").select(F.concat(F.lit("t"), F.col("n_regionkey").cast("string")).alias("region"), F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("template_col"), "n_name", "n_nationkey")
    before = n.select("template_col", F.when(F.col("n_nationkey") % 3 == 1, F.col("n_name")).alias("source_col"))
    after = n.where("n_nationkey % 3 <> 0").select("template_col", "n_name").withColumnRenamed("n_name", "source_col")
    new = stores.learned(before, after).join(n.select("template_col", "region"), "template_col").select(F.col("region").alias("template_col"), "alias")
    store = n.where("n_nationkey % 3 = 0").select(F.col("region").alias("template_col"), F.lit("known").alias("alias"))
    return stores.add_synonyms(store, new)


@query("SELECT n_regionkey, sha256('m|' || array_to_string(list_sort(list('c' || n_nationkey || '=text')), '|') || '|' || array_to_string(list_sort(list(lower(replace(n_name, '_', ' ')) || '=code')), '|')) AS key FROM nation GROUP BY n_regionkey")
def cache_key(spark, sf_dir):
    """The key the cache uses; order, case and marks of names don't matter"""
    heads = _t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("s"), F.collect_list(F.concat(F.lit("C"), F.col("n_nationkey").cast("string"))).alias("t")).collect()  # one header each
    keys = [(r.n_regionkey, providers.cache_key("m", r.t, r.s, dict.fromkeys(r.t, "text"), dict.fromkeys(r.s, "code"))) for r in heads]
    return spark.createDataFrame(keys, "n_regionkey int, key string")


@query("SELECT n_regionkey, sha256('m|' || array_to_string(list_sort(list(lower(replace(n_name, '_', ' ')) || '=')), '|')) AS key FROM nation GROUP BY n_regionkey")
def cache_key_column(spark, sf_dir):
    """M10 as a column: many headers at once"""
    heads = _t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("s"))
    tags = providers.tags(F.col("s"), F.create_map().cast("map<string, string>"))
    return heads.select("n_regionkey", F.sha2(F.concat_ws("|", F.lit("m"), F.array_sort(tags)), 256).alias("key"))


@query("SELECT n_regionkey, sha256('t.xlsx::' || array_to_string(list_sort(list(lower(replace(n_name, '_', ' ')))), '|')) AS key FROM nation GROUP BY n_regionkey")
def preset_key(spark, sf_dir):
    """M15"""
    heads = _t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("s"))
    return heads.select("n_regionkey", stores.preset_key(F.lit("t.xlsx"), F.col("s")).alias("key"))


@query("SELECT column_name AS extra FROM duckdb_columns() WHERE table_name = 'customer' AND column_name NOT IN ('c_custkey', 'c_acctbal', 'c_mktsegment')")
def extra_columns(spark, sf_dir):
    """Source columns that no mapping uses"""
    from ..operators.matching import unmapped_sources

    sources = spark.createDataFrame([("f", c, i) for i, c in enumerate(_t(spark, sf_dir, "customer").columns)], "group string, source_col string, s_pos int")
    maps = spark.createDataFrame([("f", [(c, c, "exact", 100.0) for c in ("c_custkey", "c_acctbal", "c_mktsegment")])], f"group string, mappings array<{MAPPING}>")
    return unmapped_sources(sources, maps).select(F.explode("extra").alias("extra"))
