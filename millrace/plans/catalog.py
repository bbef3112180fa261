"""Registry of the engine's own queries over the driver's tables, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import config as conf
from ..functions import dates, infer, numbers, similarity, text
from ..operators import clean, header, matching, report
from .model import CleanRules, Mapping, Template, TemplateColumn

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


# ---------------------------------------------------------------- numbers

def _grouped(cents, comma: str, dot: str):
    whole = F.regexp_replace(F.floor(F.abs(cents) / 100).cast("string"), r"(\d)(?=(\d{3})+$)", f"$1{comma}")
    return F.concat(whole, F.lit(dot), F.lpad((F.abs(cents) % 100).cast("string"), 2, "0"))


@query("SELECT o_orderkey, cast(round(o_totalprice * 100) as bigint) / 100.0::double AS value FROM orders")
def parse_number_us(spark, sf_dir):
    """1,234.56"""
    return _t(spark, sf_dir, "orders").select("o_orderkey", numbers.parse_number(_grouped(_cents("o_totalprice"), ",", ".")).alias("value"))


@query("SELECT o_orderkey, cast(round(o_totalprice * 100) as bigint) / 100.0::double AS value FROM orders")
def parse_number_vn(spark, sf_dir):
    """1.234,56"""
    return _t(spark, sf_dir, "orders").select("o_orderkey", numbers.parse_number(_grouped(_cents("o_totalprice"), ".", ",")).alias("value"))


@query("SELECT c_custkey, -(abs(cast(round(c_acctbal * 100) as bigint)) / 100.0::double) AS value FROM customer")
def parse_number_paren(spark, sf_dir):
    """(1,234.56)"""
    return _t(spark, sf_dir, "customer").select("c_custkey", numbers.parse_number(F.concat(F.lit("("), _grouped(_cents("c_acctbal"), ",", "."), F.lit(")"))).alias("value"))


@query("SELECT o_orderkey, cast(trunc(o_totalprice) as bigint)::double AS value FROM orders")
def parse_number_currency(spark, sf_dir):
    """500,000 ₫, $500000, 500.000.000đ"""
    whole = F.col("o_totalprice").cast("long").cast("string")
    mess = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.regexp_replace(whole, r"(\d)(?=(\d{3})+$)", "$1,"), F.lit(" ₫"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("$ "), whole)).otherwise(F.concat(whole, F.lit("đ")))
    return _t(spark, sf_dir, "orders").select("o_orderkey", numbers.parse_number(mess).alias("value"))


@query("SELECT c_custkey, name_value, segment_value, (name_value IS NULL)::int + (segment_value IS NULL)::int AS errors FROM (SELECT c_custkey, try_cast(c_name || 'x' AS double) AS name_value, try_cast(c_mktsegment AS double) AS segment_value FROM customer)")
def number_bad_format(spark, sf_dir):
    """Texts that are no numbers"""
    c = _t(spark, sf_dir, "customer")
    a, b = numbers.parse_number(F.concat(F.col("c_name"), F.lit("x"))), numbers.parse_number(F.col("c_mktsegment"))
    return c.select("c_custkey", a.alias("name_value"), b.alias("segment_value"), (a.isNull().cast("int") + b.isNull().cast("int")).alias("errors"))


@query("SELECT l_orderkey, l_linenumber, cast(trunc(l_extendedprice) as bigint) AS whole, -cast(trunc(l_extendedprice) as bigint) AS negative FROM lineitem")
def int_truncate(spark, sf_dir):
    """Truncation toward zero"""
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.truncated(F.col("l_extendedprice")).alias("whole"), numbers.truncated(-F.col("l_extendedprice")).alias("negative"))


# ---------------------------------------------------------------- dates

#: Formats by key modulo their number: pattern for Spark, and the same for the oracle.
_FORMATS = ("dd/MM/yyyy", "yyyy-MM-dd", "dd-MM-yyyy", "dd.MM.yyyy", "yyyy/MM/dd", "dd-MMM-yyyy", "dd MMM yyyy", "yyyyMMdd", "yyyy-MM-dd HH:mm:ss")


@query("""SELECT o_orderkey, strftime(coalesce(try_strptime(s, ['%d/%m/%Y', '%Y-%m-%d', '%d-%m-%Y', '%d.%m.%Y', '%Y/%m/%d', '%d-%b-%Y', '%d %b %Y', '%Y%m%d']), try_cast(s as timestamp)), '%d/%m/%Y') AS shown
FROM (SELECT o_orderkey, CASE o_orderkey % 9 """ + " ".join(f"WHEN {i} THEN strftime(o_orderdate, '{p}')" for i, p in enumerate(("%d/%m/%Y", "%Y-%m-%d", "%d-%m-%Y", "%d.%m.%Y", "%Y/%m/%d", "%d-%b-%Y", "%d %b %Y", "%Y%m%d", "%Y-%m-%d %H:%M:%S"))) + " END AS s FROM orders)")
def parse_date_multi(spark, sf_dir):
    """Nine ways to write a date"""
    key, s = F.col("o_orderkey") % len(_FORMATS), F.lit(None)
    for i, p in enumerate(_FORMATS):
        s = F.when(key == i, F.date_format("o_orderdate", p)).otherwise(s)
    return _t(spark, sf_dir, "orders").select("o_orderkey", dates.format_date(dates.parse_date(s)).alias("shown"))


@query("""SELECT o_orderkey, coalesce(try_strptime(s, '%d/%m/%Y'), try_strptime(s, '%m/%d/%Y')) AS parsed FROM (SELECT o_orderkey, strftime(o_orderdate, '%m/%d/%Y') AS s FROM orders)""")
def date_ambiguous_dm(spark, sf_dir):
    """Month written first is read as day where it can be"""
    return _t(spark, sf_dir, "orders").select("o_orderkey", dates.parse_date(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("parsed"))


@query("SELECT o_orderkey, date_trunc('second', o_orderdate::timestamp) AS parsed FROM orders")
def excel_serial(spark, sf_dir):
    """Days since 1899-12-30"""
    days = (F.unix_timestamp("o_orderdate") - F.unix_timestamp(F.lit("1899-12-30 00:00:00"))) / 86400
    return _t(spark, sf_dir, "orders").select("o_orderkey", dates.excel_date(days).alias("parsed"))


@query("""SELECT o_orderkey, try_strptime(strftime(o_orderdate, '%d/%m/') || CASE WHEN y >= 69 THEN '19' ELSE '20' END || lpad(cast(y as varchar), 2, '0'), '%d/%m/%Y') AS parsed
FROM (SELECT o_orderkey, o_orderdate, (o_orderkey * 7) % 100 AS y FROM orders)""")
def two_digit_year(spark, sf_dir):
    """69 to 99 are 19xx"""
    s = F.concat(F.date_format("o_orderdate", "dd/MM/"), F.lpad(((F.col("o_orderkey") * 7) % 100).cast("string"), 2, "0"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", dates.parse_date(s).alias("parsed"))


@query("""SELECT o_orderkey, try_strptime((['không phải ngày', '30/02/2000', 'today', '10:30', 'n/a', '', '32/13/2000'])[o_orderkey % 7 + 1], ['%d/%m/%Y', '%m/%d/%Y', '%Y-%m-%d', '%d.%m.%Y']) AS parsed FROM orders""")
def date_bad_format(spark, sf_dir):
    """Texts that are no dates"""
    bad = F.element_at(F.array(*map(F.lit, ["không phải ngày", "30/02/2000", "today", "10:30", "n/a", "", "32/13/2000"])), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", dates.parse_date(bad).alias("parsed"))


# ---------------------------------------------------------------- text


@query("SELECT c_custkey, upper(c_mktsegment) AS up, lower(c_mktsegment) AS low, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS titled, c_mktsegment AS trimmed FROM customer")
def text_case(spark, sf_dir):
    """Case and white space, no-break spaces too"""
    padded = F.concat(F.lit("\u00a0 \t"), F.col("c_mktsegment"), F.lit(" \u2003"))
    made = {n: text.clean_text(padded, normalize_unicode=False, case=c) for n, c in (("up", "upper"), ("low", "lower"), ("titled", "title"), ("trimmed", "none"))}
    return _t(spark, sf_dir, "customer").select("c_custkey", *[v.alias(n) for n, v in made.items()])


@query("SELECT c_custkey, c_mktsegment AS plain FROM customer")
def text_nfkc(spark, sf_dir):
    """Full-width forms become plain ones"""
    wide = F.translate("c_mktsegment", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(chr(0xFF21 + i) for i in range(26)))
    return _t(spark, sf_dir, "customer").select("c_custkey", text.clean_text(wide).alias("plain"))


@query("SELECT doc_id, sha256(trim(regexp_replace(replace(replace(lower(strip_accents(text)), '_', ' '), '-', ' '), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS folded FROM documents")
def documents_fold(spark, sf_dir):
    """M1 over whole texts"""
    return _t(spark, sf_dir, "documents").select("doc_id", F.sha2(text.normalize_name(F.coalesce("text", F.lit(""))), 256).alias("folded"))


_NAMES = ("Mã NV", "Ma_NV", "Họ và tên", "Ho ten", "Ngày sinh", "Ngay-sinh", "Địa chỉ", "  Số   tiền ", "GHI CHÚ", "Lương")


@query(f"SELECT name, trim(regexp_replace(replace(replace(lower(strip_accents(name)), '_', ' '), '-', ' '), ' +', ' ', 'g')) AS norm FROM (VALUES {', '.join(f"('{n}')" for n in _NAMES)}) AS v(name)")
def normalize_header(spark, sf_dir):
    """M1: names of columns"""
    return spark.createDataFrame([(n,) for n in _NAMES], "name string").select("name", text.normalize_name(F.col("name")).alias("norm"))


# ---------------------------------------------------------------- similarity and matching

_PAIRS = (("ngay thang nam sinh", "ngay sinh"), ("ho va ten", "ho ten"), ("ngay sinh", "ns"), ("abcd", "acbd"), ("ma nv", "nv ma"), ("so tien", ""), ("a b c", "c d"))
_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in _PAIRS)


@query(f"""SELECT a, b, CASE WHEN len(ta) > 0 AND len(tb) > 0 THEN len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))) * 100.0 ELSE 0.0 END::double AS overlap
FROM (SELECT a, b, list_filter(string_split(a, ' '), lambda x: x <> '') AS ta, list_filter(string_split(b, ' '), lambda x: x <> '') AS tb FROM (VALUES {_VALUES}) AS v(a, b))""")
def token_overlap(spark, sf_dir):
    """M2"""
    return spark.createDataFrame(_PAIRS, "a string, b string").select("a", "b", similarity.token_overlap(F.col("a"), F.col("b")).alias("overlap"))


@query(f"""WITH RECURSIVE v AS (SELECT * FROM (VALUES {_VALUES}) AS v(a, b)),
r AS (SELECT a, b, 0 AS i, list_transform(range(0, len(b) + 1), lambda j: 0) AS row FROM v
      UNION ALL SELECT a, b, i + 1, list_reduce(range(0, len(b) + 1), lambda acc, j: CASE WHEN j = 0 THEN acc ELSE list_append(acc, greatest(acc[j], row[j + 1], CASE WHEN a[i + 1] = b[j] THEN row[j] + 1 ELSE 0 END)) END, [0]::INTEGER[]) FROM r WHERE i < len(a))
SELECT a, b, round(200.0 * row[len(b) + 1] / (len(a) + len(b)), 6)::double AS score FROM r WHERE i = len(a)""")
def indel_ratio(spark, sf_dir):
    """M3a"""
    return spark.createDataFrame(_PAIRS, "a string, b string").select("a", "b", F.round(similarity.indel_ratio(F.col("a"), F.col("b")), 6).alias("score"))




_TYPES = tuple((t, s) for t in ("text", "date", "money", "price", "phone", None) for s in ("text", "date", "number", "email", "unknown", "code", None))


@query(f"""SELECT t, s, CASE WHEN t IS NULL OR s IS NULL OR s = 'unknown' OR t = 'price' THEN 0.0
  WHEN (t = 'text' AND s IN ('text', 'code', 'email', 'phone')) OR (t = 'date' AND s = 'date') OR (t = 'money' AND s IN ('money', 'number', 'int')) OR (t = 'phone' AND s = 'phone') THEN 15.0 ELSE -12.0 END::double AS bonus
FROM (VALUES {', '.join('(' + ', '.join('NULL' if x is None else f"'{x}'" for x in p) + ')' for p in _TYPES)}) AS v(t, s)""")
def type_bonus(spark, sf_dir):
    """M4"""
    return spark.createDataFrame(_TYPES, "t string, s string").select("t", "s", similarity.type_bonus(F.col("t"), F.col("s")).alias("bonus"))








# ---------------------------------------------------------------- type inference


@query("""SELECT * FROM (VALUES ('c_acctbal', 'number'), ('c_email', 'email'), ('c_mktsegment', 'code'), ('c_name', 'code'), ('c_phone', 'phone'), ('c_price', 'money'), ('o_date', 'date'), ('o_note', 'text')) AS v(name, inferred)""")
def infer_type_per_column(spark, sf_dir):
    """Types from the first twenty values of each column"""
    c = _t(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    cols = {
        "c_acctbal": F.concat(F.regexp_replace(F.col("c_acctbal").cast("decimal(12,2)").cast("string"), r"\.", ","), F.lit(",0")), "c_email": F.concat(F.lit("u"), key, F.lit("@example.com")), "c_mktsegment": F.col("c_mktsegment"), "c_name": F.regexp_replace("c_name", "#", "-"),
        "c_phone": F.concat(F.lit("+84 91 "), F.lpad(key, 7, "8")), "c_price": F.concat(key, F.lit(",000 ₫")), "o_date": F.concat(F.lit("1999-01-"), F.lpad(key, 2, "0")), "o_note": F.concat(F.lit("note no "), key),
    }
    values = F.create_map(*[x for n, v in cols.items() for x in (F.lit(n), v)])
    recs = c.select(F.lit("f").alias("source_path"), F.lit("s").alias("sheet"), F.col("c_custkey").alias("row_idx"), values.alias("values"))
    return infer.infer_types(header.samples(recs), ["name"])


@query("""SELECT event_type, event_id, value FROM (SELECT event_type, event_id, cast(cast(event_id * 3 as bigint) as varchar) AS value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events WHERE event_id % 4 <> 0) WHERE n <= 20""")
def sample_first20(spark, sf_dir):
    """The first values of each column that aren't empty"""
    e = _t(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 4 != 0, (F.col("event_id") * 3).cast("string")).otherwise(F.lit(" "))
    recs = e.select(F.lit("f").alias("source_path"), F.lit("s").alias("sheet"), F.col("event_id").alias("row_idx"), F.create_map("event_type", value).alias("values"))
    return header.samples(recs).select(F.col("name").alias("event_type"), F.col("row_idx").alias("event_id"), "value")


# ---------------------------------------------------------------- cleaning and reports

_TEMPLATE = Template((
    TemplateColumn("key", data_type="int", order=0), TemplateColumn("status", default="NA", order=1), TemplateColumn("total", data_type="number", default=0, order=2),
    TemplateColumn("day", data_type="date", order=3), TemplateColumn("absent", default="zz", order=4),
))
_MAPPINGS = [Mapping("key", "k", "exact", 100.0), Mapping("status", "s", "fuzzy", 80.0), Mapping("total", "t", "fuzzy", 80.0), Mapping("day", "d", "synonym", 100.0), Mapping("absent", None, "unmapped", 0.0)]


def _messy_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as strings: blanks, thousands marks, ways to write dates, every tenth or so broken."""
    k = F.col("o_orderkey")
    return _t(spark, sf_dir, "orders").select(
        k.alias("row_idx"), F.concat(F.lit(" "), k.cast("string")).alias("k"), F.when(k % 5 != 0, F.concat(F.lit("  "), F.col("o_orderstatus"))).otherwise(F.lit(" ")).alias("s"),
        F.when(k % 7 == 0, F.lit("?")).when(k % 11 != 0, _grouped(_cents("o_totalprice"), ".", ",")).alias("t"), F.when(k % 13 == 0, F.lit("soon")).when(k % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("d"), F.lit("x").alias("extra"),
    )


_CLEAN = """SELECT o_orderkey AS row_idx, o_orderkey AS key, CASE WHEN o_orderkey % 5 <> 0 THEN trim(o_orderstatus) ELSE 'NA' END AS status,
CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 <> 0 THEN cast(round(o_totalprice * 100) as bigint) / 100.0::double ELSE 0.0 END::double AS total,
CASE WHEN o_orderkey % 13 <> 0 THEN strftime(o_orderdate, '%d/%m/%Y') END AS day, cast(NULL as varchar) AS absent FROM orders"""


@query(_CLEAN)
def clean_orders(spark, sf_dir):
    """The flagship"""
    return clean.apply_rules(_messy_orders(spark, sf_dir), _TEMPLATE, _MAPPINGS, CleanRules()).select("row_idx", *_TEMPLATE.names)


_ISSUES = """SELECT o_orderkey + 2 AS row, 'total' AS "column", 'error' AS severity, 'bad_format' AS type, '?' AS value FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT o_orderkey + 2, 'day', 'error', 'bad_format', 'soon' FROM orders WHERE o_orderkey % 13 = 0
UNION ALL SELECT o_orderkey + 2, 'status', 'warning', 'missing_value', 'NA' FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT o_orderkey + 2, 'total', 'warning', 'missing_value', '0' FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 = 0"""


@query(_ISSUES)
def issues_long(spark, sf_dir):
    """A1, A2: the issue log"""
    return clean.issue_log(clean.apply_rules(_messy_orders(spark, sf_dir), _TEMPLATE, _MAPPINGS, CleanRules())).select("row", "column", "severity", "type", "value")


@query(f"SELECT severity, type, count(*) AS n FROM ({_ISSUES}) GROUP BY ALL")
def issue_counts(spark, sf_dir):
    """A3"""
    return issues_long(spark, sf_dir).groupBy("severity", "type").agg(F.count("*").alias("n"))


@query("""SELECT count(*) * 2 - count(*) FILTER (o_orderkey % 7 = 0) - count(*) FILTER (o_orderkey % 7 <> 0 AND o_orderkey % 11 = 0) + 0 AS total_or_key, count(*) FILTER (o_orderkey % 5 = 0) + count(*) FILTER (o_orderkey % 7 <> 0 AND o_orderkey % 11 = 0) AS filled FROM orders""")
def clean_stats(spark, sf_dir):
    """A1: cells changed and defaults filled in (key and total alone: all keys and totals change)"""
    template = Template(tuple(c for c in _TEMPLATE.columns if c.name in ("key", "total")))
    own = clean.apply_rules(_messy_orders(spark, sf_dir), template, _MAPPINGS, CleanRules())
    both = clean.apply_rules(_messy_orders(spark, sf_dir), _TEMPLATE, _MAPPINGS, CleanRules())
    return own.agg(F.sum("cleaned_cells").alias("total_or_key")).crossJoin(both.agg(F.sum("filled_defaults").alias("filled")))


@query("""WITH f AS (SELECT o_custkey % 50 AS file, count(*) FILTER (o_orderkey % 97 = 0) AS errors, count(*) FILTER (o_orderkey % 3 = 0) AS warnings, count(*) AS n FROM orders GROUP BY 1)
SELECT 'f' || file AS source_path, n AS row_count, errors AS error_count, warnings AS warning_count, CASE WHEN file = 7 THEN 'failed' WHEN errors = 0 THEN 'ok' ELSE 'partial' END AS status FROM f""")
def file_status(spark, sf_dir):
    """A3, A4, A6"""
    o = _t(spark, sf_dir, "orders").withColumn("source_path", F.concat(F.lit("f"), (F.col("o_custkey") % 50).cast("string")))
    issues = o.where("o_orderkey % 97 = 0").select("source_path", F.lit("error").alias("severity")).union(o.where("o_orderkey % 3 = 0").select("source_path", F.lit("warning").alias("severity")))
    files = o.groupBy("source_path").agg(F.count("*").alias("row_count")).withColumn("error_message", F.when(F.col("source_path") == "f7", "broken").otherwise(""))
    return report.file_reports(files, issues).select("source_path", "row_count", "error_count", "warning_count", "status")


@query("""WITH f AS (SELECT o_custkey % 50 AS file, count(*) FILTER (o_orderkey % 97 = 0) AS errors FROM orders GROUP BY 1)
SELECT count(*) FILTER (file <> 7 AND errors = 0) AS ok_count, count(*) FILTER (file = 7) AS failed_count, count(*) AS files FROM f""")
def batch_counts(spark, sf_dir):
    """A5"""
    return report.batch_report(file_status(spark, sf_dir))


@query("SELECT c_name AS \"Tên\", cast(NULL as varchar) AS \"Lương\", c_custkey AS \"Mã\" FROM customer")
def reorder_project(spark, sf_dir):
    """P1"""
    template = Template((TemplateColumn("Tên"), TemplateColumn("Lương"), TemplateColumn("Mã")))
    return clean.reorder(_t(spark, sf_dir, "customer"), template, [Mapping("Tên", "c_name", "manual", 100.0), Mapping("Mã", "c_custkey", "manual", 100.0), Mapping("Lương", None, "unmapped", 0.0)])


# ---------------------------------------------------------------- stores, providers, settings









_DEFAULTS = ("", "True", "false", "12", "-7", "1.5", "1e3", "abc", " x ", "12a")


@query(f"""SELECT raw, CASE WHEN trim(raw) = '' THEN 'null' WHEN trim(raw) IN ('True', 'true', 'False', 'false') THEN 'bool' WHEN regexp_full_match(trim(raw), '[+-]?[0-9]+') THEN 'int' WHEN try_cast(trim(raw) AS double) IS NOT NULL THEN 'float' ELSE 'text' END AS kind,
CASE WHEN trim(raw) = '' THEN NULL WHEN trim(raw) IN ('True', 'true', 'False', 'false') THEN lower(trim(raw)) WHEN try_cast(trim(raw) AS double) IS NOT NULL AND NOT regexp_full_match(trim(raw), '[+-]?[0-9]+') THEN cast(cast(trim(raw) AS double) AS varchar) ELSE trim(raw) END AS value FROM (VALUES {', '.join(f"('{d}')" for d in _DEFAULTS)}) AS v(raw)""")
def default_value_parse(spark, sf_dir):
    """K7"""
    return spark.createDataFrame([(d,) for d in _DEFAULTS], "raw string").select("raw", conf.parse_default(F.col("raw")).alias("p")).select("raw", "p.kind", "p.value")


_PATHS = ("/mnt/d/foo/bar", "D:\\foo\\bar", "d:/foo", "\\mnt\\c\\x", "/home/u/x", "relative/p")


@query(f"""SELECT path, coalesce(CASE WHEN regexp_matches(s, '^/mnt/[a-zA-Z]/') THEN '/mnt/' || lower(s[6]) || s[7:] WHEN regexp_matches(s, '^[a-zA-Z]:/') THEN '/mnt/' || lower(s[1]) || s[3:] END, path) AS posix,
CASE WHEN regexp_matches(s, '^/mnt/[a-zA-Z]/') THEN upper(s[6]) || ':' || replace(s[7:], '/', chr(92)) ELSE path END AS windows FROM (SELECT path, replace(path, chr(92), '/') AS s FROM (VALUES {', '.join(f"('{p}')" for p in _PATHS)}) AS v(path))""")
def path_translate(spark, sf_dir):
    """K5"""
    return spark.createDataFrame([(p,) for p in _PATHS], "path string").select("path", conf.to_posix(F.col("path")).alias("posix"), conf.to_windows(F.col("path")).alias("windows"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messy orders cleaned to a template of five columns, with what was wrong."""
    return clean.apply_rules(_messy_orders(spark, sf_dir), _TEMPLATE, _MAPPINGS).select("row_idx", *_TEMPLATE.names, F.size("issues").alias("n_issues"))


from . import catalog_files  # noqa: E402, F401  registers its queries
