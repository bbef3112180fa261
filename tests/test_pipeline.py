import json
import time

import pytest
from pyspark.sql import functions as F

from millrace.operators import header, layout
from millrace.operators.clean import apply_rules, issue_log, merged
from millrace.plans import catalog, providers, staging, stores
from millrace.plans.model import AIConfig, CleanRules, Mapping, Settings, Template, TemplateColumn, load_meta, template_of
from millrace.plans.pipeline import load_template, read_records, source_columns, standardize, standardize_records
from millrace.sources import sinks
from millrace.sources.decode import csv_rows, sheet_names, write_xlsx, xlsx_rows
from millrace.sources.files import discover, engine, entries, large_csv
from millrace.streaming.clean import read_folder, write_cleaned

#: The source rows, template and expected cells that the specified behaviour is stated with.
SOURCE = 'Ma_NV,Ten,Ngay sinh,Luong,Ghi chu\nA1,"  An  ",2000-02-01,"1,000,000",x\nA2,Binh,15/03/1999,2.500.000,y\n'
TEMPLATE = Template((TemplateColumn("Mã NV", True, order=0), TemplateColumn("Tên", True, order=1), TemplateColumn("Ngày sinh", data_type="date", order=2), TemplateColumn("Lương", data_type="number", default=0, order=3)))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    for name in ("a.csv", "b.csv"):
        (d / name).write_text(SOURCE)
    (d / "c.csv").write_text("xxx,yyy\na,b\n")
    (d / "dup.csv").write_text("Ten,Ten,Luong\nAn,An,5\n")
    (d / "broken.xlsx").write_bytes(b"no zip")
    (d / "scan.pdf").write_bytes(b"%PDF")
    (d / "note.txt").write_text("ignored")
    (d / "d.xlsx").write_bytes(write_xlsx(["Ma_NV", "Ten", "Ngay sinh", "Luong", "Ghi chu"], iter([["A1", "An", "2000-02-01", "1,000,000", "x"]])))
    (d / "turned.xlsx").write_bytes(write_xlsx(["Ma_NV", 1, 2, 3], iter([["Ten", "An", "Binh", "Chi"], ["Ngay sinh", "1/2/2000", "2/2/2000", "3/2/2000"]])))
    return d


@pytest.fixture(scope="module")
def result(spark, folder):
    return standardize(discover(spark, str(folder)), TEMPLATE)


def by_file(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.source_path.rsplit("/", 1)[-1], []).append(r)
    return out


def test_tables(result):
    rows = by_file(result.table)
    for name in ("a.csv", "b.csv"):
        assert [tuple(r)[2:] for r in sorted(rows[name], key=lambda r: r.row_idx)] == [("A1", "An", "01/02/2000", "1000000.0"), ("A2", "Binh", "15/03/1999", "2500000.0")]
    assert [tuple(r)[2:] for r in rows["d.xlsx"]] == [("A1", "An", "01/02/2000", "1000000.0")]
    assert sorted(tuple(r)[2:5] for r in rows["turned.xlsx"]) == [("1", "An", "01/02/2000"), ("2", "Binh", "02/02/2000"), ("3", "Chi", "03/02/2000")]
    assert [tuple(r)[2:] for r in rows["c.csv"]] == [(None, None, None, None)]


def test_reports(result):
    got = {k: v[0] for k, v in by_file(result.reports).items()}
    assert {k: r.status for k, r in got.items()} == {"a.csv": "ok", "b.csv": "ok", "c.csv": "partial", "d.xlsx": "ok", "dup.csv": "partial", "broken.xlsx": "failed", "scan.pdf": "failed", "turned.xlsx": "partial"}
    assert "BackendMissing" in got["scan.pdf"].error_message
    batch = result.batch.first()
    assert (batch.ok_count, batch.failed_count) == (3, 2)
    issues = by_file(result.issues)
    assert [(r.row, r["column"], r.type) for r in issues["a.csv"]] == [(0, "Ghi chu", "extra_column")]
    assert "duplicate_header" in {r.type for r in issues["dup.csv"]}


def test_override_and_suggester(spark, folder):
    files = discover(spark, str(folder)).where("path like '%/a.csv' or path like '%/c.csv'")
    given = [Mapping("Tên", "Ghi chu", "manual", 100.0)]
    got = {k: v[0].mappings[0] for k, v in by_file(standardize(files, TEMPLATE, override=given).mappings.withColumnRenamed("group", "source_path")).items()}
    assert got["a.csv"].source_col == "Ghi chu" and got["c.csv"].match_source == "unmapped"
    asked = []

    def transport(template, sources):
        asked.append((template, sources))
        return "Mã NV -> xxx"

    helper = providers.CachedSuggester(AIConfig(enabled=True, api_key="k", model="m"), transport)
    out = by_file(standardize(files, TEMPLATE, Settings(), suggester=helper).mappings.withColumnRenamed("group", "source_path"))
    assert {m.template_col: m.match_source for m in out["c.csv"][0].mappings} == {"Mã NV": "ai", "Tên": "unmapped", "Ngày sinh": "unmapped", "Lương": "unmapped"}
    assert len(asked) == 1  # a.csv needed no help


def test_cleaning_of_a_frame(spark):
    df = spark.createDataFrame([(0, "01/02/2000", "1,000,000", "  An  ", None), (1, "not-a-date", "?", "", "n")], "row_idx long, NS string, Luong string, Ten string, Note string")
    t = Template((TemplateColumn("NS", data_type="date"), TemplateColumn("Luong", data_type="number", default=5), TemplateColumn("Ten", data_type="text"), TemplateColumn("Note", default="NA")))
    maps = [Mapping(n, n, "exact", 100.0) for n in t.names]
    out = apply_rules(df, t, maps, CleanRules())
    assert [tuple(r)[1:] for r in merged(out, t).orderBy("row_idx").collect()] == [("01/02/2000", "1000000.0", "An", "NA"), ("not-a-date", "?", None, "n")]
    assert sorted((r.row, r["column"], r.severity, r.type) for r in issue_log(out).collect()) == [(2, "Note", "warning", "missing_value"), (3, "Luong", "error", "bad_format"), (3, "NS", "error", "bad_format")]
    assert sinks.issue_csv(issue_log(out)).startswith("\ufeffDòng,Cột".encode())


def test_workbook_round_trip():
    data = write_xlsx(["a", "b"], iter([[1, "x & <y>"], [None, 2.5], ["", True]]))
    (name, part), *_ = sheet_names(data)
    rows = list(xlsx_rows(data, part))
    assert name == "Sheet1"
    assert rows[1] == [("n", "1", 1.0), ("s", "x & <y>", None)]
    assert rows[2] == [None, ("n", "2.5", 2.5)]
    assert rows[3][1] == ("s", "True", None)


def test_csv_rows():
    assert [[c and c[1] for c in r] for r in csv_rows('\ufeffa,b\n\n1,NA\n1,2,3\n"x\ny",\n'.encode())] == [["a", "b"], ["1", None], ["x\ny", None]]


def test_sink_names(spark, result):
    assert list(sinks.output_names(["x/a.csv", "y/a.xlsx", "b.csv"]).values()) == ["a_standardized.xlsx", "a_standardized_2.xlsx", "b_standardized.xlsx"]
    books = {r.source_path.rsplit("/", 1)[-1]: r.content for r in sinks.write_workbooks(result.table, TEMPLATE.names).collect()}
    rows = list(xlsx_rows(bytes(books["a.csv"]), sheet_names(bytes(books["a.csv"]))[0][1]))
    assert [c[1] for c in rows[0]] == TEMPLATE.names and len(rows) == 3


def test_template_and_sidecar(spark, tmp_path):
    path = tmp_path / "mau.xlsx"
    path.write_bytes(write_xlsx(TEMPLATE.names, iter([])))
    TEMPLATE.save_meta(path)
    assert set(load_meta(path)["columns"]) == {"Mã NV", "Tên", "Ngày sinh", "Lương"}
    got = load_template(spark, str(path))
    assert got.names == TEMPLATE.names and got.required == ["Mã NV", "Tên"] and got.columns[3].default == 0
    assert got.schema()["Lương"].dataType.typeName() == "double"
    assert template_of(["a", ""]).names == ["a", "COL_2"]
    (tmp_path / "bad.csv.template.json").write_text("{")
    assert load_meta(tmp_path / "bad.csv") is None


def test_settings_round_trip(tmp_path):
    Settings(fuzzy_threshold=70.0, default_skip_rows=2, clean=CleanRules(case="upper")).save(tmp_path / "s.json")
    got = Settings.load(tmp_path / "s.json")
    assert (got.fuzzy_threshold, got.default_skip_rows, got.clean.case) == (70.0, 2, "upper")
    assert Settings.load(tmp_path / "none.json") == Settings()


def test_replies():
    t, s = ["STT", "Tên", "Ngày sinh"], ["ID", "Name", "DOB"]
    assert providers.parse_reply('sure: {"STT": "ID", "X": "Name"} ok', t, s) == {"STT": "ID"}
    assert providers.parse_reply("1. STT [text] -> ID [number]\n2. Tên => Name", t, s) == {"STT": "ID", "Tên": "Name"}
    assert providers.parse_reply('1. STT [text] -> ... Source has "ID [number]". A match.', t, s) == {"STT": "ID"}
    assert providers.parse_reply("no idea", t, s) is None
    assert providers.parse_reply("{}", t, s) == {}


def test_replies_of_other_forms():
    t, s = ["A", "B: c"], ["x", "y -> z", "u"]
    assert providers.parse_reply('[1, 2]\n- A -> "x",', t, s) == {"A": "x"}
    assert providers.parse_reply('{"A": 5, "B: c": "x"}', t, s) == {"B: c": "x"}
    assert providers.parse_reply("{broken\nA: x\nA: u}", t, s) == {"A": "x"}
    assert providers.parse_reply('"A" [code] => y -> z', t, s) is None or providers.parse_reply('"A" [code] => y -> z', t, s) == {"A": "y -> z"}
    assert providers.parse_reply("", t, s) is None


def test_one_cache_key(spark):
    """The cache asks once for headers that differ in case, marks and order, under the key that the column function gives."""
    calls = []
    suggester = providers.CachedSuggester(AIConfig(enabled=True, api_key="k", model="m"), lambda a, b: calls.append(1) or '{"A": "Ngày sinh"}')
    suggester.suggest(["A"], ["Ngày sinh", "Họ_tên"])
    suggester.suggest(["A"], ["HO TEN", "Ngay-sinh"])
    assert len(calls) == 1
    names = ["Ngày sinh", "  Họ_tên ", "ĐỊA-CHỈ", "ﬁ Ⅳ", "a\u00a0b"]
    df = spark.createDataFrame([(names,)], "n array<string>")
    tags = providers.tags(F.col("n"), F.create_map().cast("map<string, string>"))
    assert df.select(providers.key_column("m", tags, F.array(F.lit("x=")))).first()[0] == providers.cache_key("m", names, ["x"])


def test_chat_transport():
    import io

    asked = []

    def opener(request, timeout):
        asked.append((request.full_url, json.loads(request.data), timeout))
        return io.BytesIO(json.dumps({"choices": [{"message": {"content": '{"A": "x"}'}}]}).encode())

    suggester = providers.CachedSuggester(config := AIConfig(enabled=True, api_key="k", model="m", base_url="http://h/v1/"), providers.chat_transport(config, opener))
    assert suggester.suggest(["A"], ["x"], {"A": "date"}, {"x": "text"}) == {"A": "x"}
    url, body, timeout = asked[0]
    assert url == "http://h/v1/chat/completions" and timeout == 60.0 and body["max_tokens"] == 300 and body["temperature"] == 0.0
    assert "A [date]" in body["messages"][1]["content"] and "x [text]" in body["messages"][1]["content"]


def test_typed_cells_of_a_workbook(spark):
    """Numbers in a date column are dates by their days, numbers with a dot are decimal, booleans are neither."""
    content = write_xlsx(["Ma_NV", "Ten", "Ngay sinh", "Luong"], iter([["A1", "An", 36557, 1.234], ["A2", "Binh", 36558.5, 20200101], ["A3", "Chi", "x", "1.234,5"], ["A4", "Dung", None, None]]))
    files = spark.createDataFrame([("t.xlsx", bytearray(content))], "path string, content binary")
    out = standardize(files, TEMPLATE)
    assert [tuple(r)[2:] for r in out.table.orderBy("row_idx").collect()] == [("A1", "An", "01/02/2000", "1.234"), ("A2", "Binh", "02/02/2000", "2.0200101E7"), ("A3", "Chi", "x", "1234.5"), ("A4", "Dung", None, "0.0")]
    assert {r.type: r.n for r in out.issues.groupBy("type").agg(F.count("*").alias("n")).collect()} == {"bad_format": 1, "missing_value": 1}
    cell = lambda kind, s, d: (kind, s, d)
    grid = spark.createDataFrame([("f", "s", 0, [cell("s", "Luong", None), cell("s", "Ngay sinh", None)]), *[("f", "s", i, [cell("b", "True", 1.0), cell("b", "True", 1.0)]) for i in (1, 2)]], header.GRID)
    recs, names = read_records(grid)
    typed = standardize_records(recs, names, TEMPLATE)
    assert typed.issues.where("type = 'bad_format'").count() == 4
    assert {r.inferred for r in source_columns(recs, names).collect()} == {"unknown"}


def test_no_limit_on_rows_and_cells(spark, tmp_path):
    """More rows than a million in a table, more cells than a hundred thousand in a row."""

    def stored(df, name):  # constants would be folded by the optimizer, row by row
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    rows = spark.range(1).select(F.lit(1).alias("page"), F.concat(F.array(F.array(F.lit("a"), F.lit("b"))), F.transform(F.sequence(F.lit(1), F.lit(1_000_005)), lambda i: F.array(i.cast("string"), F.lit("x")))).alias("rows"))
    assert layout.box_tables(stored(rows, "rows"), ["page"]).select(F.size("table.records").alias("n")).first().n == 1_000_005
    wide = lambda label, kind, n: F.concat(F.array(F.struct(F.lit("s").alias("kind"), F.lit(label).alias("s"), F.lit(None).cast("double").alias("d"))), F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(F.lit(kind).alias("kind"), i.cast("string").alias("s"), i.cast("double").alias("d"))))
    cells = F.array(F.concat(wide("k", "s", 100_100), F.slice(wide("k", "n", 900_000), 2, 900_000)), wide("l", "s", 2), wide("m", "s", 2))
    grid = spark.range(1).select(F.lit("f").alias("source_path"), F.lit("s").alias("sheet"), F.posexplode(cells).alias("row_idx", "cells"))
    assert header.transposed(stored(grid, "grid")).first().transposed


def test_a_large_csv_is_read_by_blocks(spark, tmp_path):
    """Numbers of rows follow the file, whatever blocks it is read in; cells as a small file's."""
    path = tmp_path / "big.csv"
    path.write_text("Ma_NV,Ten,Ngay sinh,Luong\n" + "".join(f'A{i},"An, ""{i}""",01/02/2000,{"NA" if i % 5 == 0 else i}\n' + "\n" * (i % 97 == 0) for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
        recs, names = large_csv(spark, str(path))
        assert recs.rdd.getNumPartitions() > 5
        rows = recs.orderBy("row_idx").collect()
        assert [r.row_idx for r in rows] == list(range(20_000))
        assert all(r["values"] == {"Ma_NV": f"A{r.row_idx}", "Ten": f'An, "{r.row_idx}"', "Ngay sinh": "01/02/2000", "Luong": None if r.row_idx % 5 == 0 else str(r.row_idx)} for r in rows)
        out = standardize_records(recs, names, TEMPLATE)
        assert out.table.count() == 20_000 and out.issues.where("type = 'missing_value'").count() == 4_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_staged_tables_need_a_shared_folder(spark):
    at = staging.materialized(spark.range(3), "t")
    assert at.count() == 3 and at.inputFiles()[0].startswith("file:")
    files = at.inputFiles()
    staging.clear(spark)
    assert not any(__import__("os").path.exists(f.removeprefix("file://")) for f in files)

    class Cluster:
        class sparkContext:  # noqa: N801
            master, applicationId = "local-cluster[2,1,1024]", "a"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:  # noqa: N801
            get = staticmethod(lambda k, d=None: d)

    with pytest.raises(ValueError, match="checkpoint"):
        staging.folder(Cluster)


def test_suggester_cache(tmp_path):
    calls = []

    def transport(a, b):
        calls.append(1)
        return json.dumps({"A": "x"})

    make = lambda: providers.CachedSuggester(AIConfig(enabled=True, api_key="k"), transport, tmp_path / "c.json")
    assert make().suggest(["A"], ["x", "y"]) == make().suggest(["A"], ["y", "x"]) == {"A": "x"}
    assert len(calls) == 1
    assert not providers.CachedSuggester(AIConfig(), transport).available


def test_presets(spark):
    store = spark.createDataFrame([], stores.PRESETS)
    src = spark.createDataFrame([("t", ["B", "a"])], "template_path string, cols array<string>")
    new = src.select(stores.preset_key(F.col("template_path"), F.col("cols")).alias("key"), F.array(F.struct(F.lit("A").alias("template_col"), F.lit("a").alias("source_col"), F.lit("manual").alias("match_source"), F.lit(100.0).alias("confidence"))).alias("mappings"))
    store = stores.put_preset(store, new)
    found = stores.find_presets(spark.createDataFrame([("t", ["A", "b"])], "template_path string, cols array<string>"), store).first()
    assert found.mappings[0].source_col == "a"


def test_engines(spark):
    rows = spark.createDataFrame([("a.XLSX",), ("b.csv",), ("c.webp",), ("d.txt",), ("e.xls",)], "p string").select(engine(F.col("p")).alias("e")).collect()
    assert [r.e for r in rows] == ["workbook", "csv", "document", None, "legacy"]


def tables(spark, rows, f):
    df = spark.createDataFrame([(1, rows)], "page int, rows array<array<string>>")
    found = f(df, ["page"]).first()
    return found and (found.table.names, [list(r) for r in found.table.records])


def test_page_tables(spark):
    grid = [["STT", "Tên", "Số"], ["1", "An", "100"], ["2", "Bình", "200"]]
    assert tables(spark, grid, layout.box_tables) == (grid[0], grid[1:])
    assert tables(spark, [["A", "B"], ["1"]], layout.box_tables) == (["A", "B"], [["1", None]])
    assert tables(spark, [["A", "B"]], layout.box_tables) is None
    assert tables(spark, [["a", "1", "2"], ["b", "3"], ["c"]], layout.box_tables) == (["a", "b", "c"], [["1", "3", None], ["2", None, None]])
    assert tables(spark, grid, layout.word_tables) == (["STT", "1", "2"], [["Tên", "An", "Bình"], ["Số", "100", "200"]])
    assert tables(spark, [["title"], *grid[:2]], layout.word_tables) == (grid[0], grid[1:2])
    parts = spark.createDataFrame([(1, 0, grid), (1, 1, [["h"], ["3", "Chi", "7"]])], "page int, table_idx int, rows array<array<string>>")
    assert len(layout.ruled_tables(parts, ["page"]).first().table.records) == 3


def test_header_rows_beyond_the_head(spark):
    cells = [("s", "a", None), ("s", "b", None)]
    grid = spark.createDataFrame([("f", "s", i, cells) for i in range(3)], header.GRID)
    assert header.resolved_headers(grid, skip_rows=99).first().header_row == 0
    assert header.resolved_headers(grid, header_row=2, skip_rows=1).first().header_row == 2
    assert header.resolved_headers(grid, skip_rows=1).first().header_row == 1


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(0, "1/2/2000"), (1, "x")], "row_idx long, d string")
    rows.write.parquet(str(tmp_path / "in"))
    t = Template((TemplateColumn("day", data_type="date"),))
    query = write_cleaned(read_folder(spark, str(tmp_path / "in"), rows.schema), t, [Mapping("day", "d", "manual", 100.0)], str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    assert sorted(r.day for r in spark.read.parquet(str(tmp_path / "out/table")).collect()) == ["01/02/2000", "x"]
    assert spark.read.parquet(str(tmp_path / "out/issues")).count() == 1


def test_wide_headers(spark):
    """Names take time in proportion to the width, also where a condition on them is computed with them inlined."""
    pool = ["a", "", " ", "b ", "Unnamed: 7", "c", "a"]
    plain, out, seen = ["" if i < 2 else pool[i * i % 7] for i in range(3000)], [], {}
    for i, x in enumerate(plain):
        last = out[-1] if out else "Unnamed: "
        out.append(x.strip() or (f"Unnamed: {i}" if last.startswith("Unnamed: ") else last))
    want = [n if (k := seen.setdefault(n, []).append(i) or len(seen[n])) == 1 else f"{n} ({k})" for i, n in enumerate(out)]
    grid = stored_grid(spark, [("f", "s", i, [("s", x, None) for x in plain]) for i in range(2)])
    began = time.monotonic()
    names = header.resolved_headers(grid, header_row=0).select("duplicates", F.posexplode("names").alias("pos", "name")).collect()
    assert [r.name for r in sorted(names, key=lambda r: r.pos)] == want
    assert names[0].duplicates == 3000 - len(set(out))
    assert time.monotonic() - began < 60


def test_names_are_made_of_header_rows_alone(spark):
    """A condition on names isn't tested on every row of the grid."""
    grid = stored_grid(spark, [("f", "s", i, [("s", "x", None), ("s", "y", None)]) for i in range(9)])
    plan = header.resolved_headers(grid).select(F.explode("names"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Unnamed: " in plan and "Unnamed: " not in plan.split("Join", 1)[1]


def stored_grid(spark, rows):
    return staging.materialized(spark.createDataFrame(rows, header.GRID), "grid")


def test_tables_of_part_files_are_found_once(spark, sf_dir, tmp_path):
    at = tmp_path / "a folder"
    for path in ("a.parquet", "b.parquet/part-0.parquet", "b.parquet/part-1.parquet", "b.parquet/_SUCCESS", "c.PARQUET/k=1/part-0", "sub/d.parquet", "sub/e.parquet/part-0.parquet", "f.txt/part-0.parquet", ".g.parquet", "h.txt"):
        (at / path).parent.mkdir(parents=True, exist_ok=True)
        (at / path).write_bytes(b"xy")
    found = lambda **options: {r.path.removeprefix(f"file:{at}/"): r.length for r in entries(spark, str(at), kinds=("parquet",), **options).collect()}
    assert found() == {"a.parquet": 2, "b.parquet": 4, "c.PARQUET": 2}
    assert found(recursive=True) == {"a.parquet": 2, "b.parquet": 4, "c.PARQUET": 2, "sub/d.parquet": 2, "sub/e.parquet": 2, "f.txt/part-0.parquet": 2}
    spark.read.parquet(f"{sf_dir}/customer.parquet").repartition(3).write.parquet(str(tmp_path / "tables/customer.parquet"))
    spark.read.parquet(f"{sf_dir}/nation.parquet").write.partitionBy("n_regionkey").parquet(str(tmp_path / "tables/nation.parquet"))
    assert sorted(r.name for r in catalog.queries()["file_discovery"](spark, str(tmp_path / "tables/")).collect()) == ["customer", "nation"]
