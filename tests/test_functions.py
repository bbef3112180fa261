import random
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import config, dates, infer, numbers, similarity, text


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("r")).orderBy("i").collect()
    return [r.r for r in rows]


def test_dates(spark):
    cases = {
        "01/02/2000": datetime(2000, 2, 1), "2000-02-01": datetime(2000, 2, 1), "15/03/1999": datetime(1999, 3, 15), "12/25/2000": datetime(2000, 12, 25), "1.2.2000": datetime(2000, 2, 1), "1/2/68": datetime(2068, 2, 1), "1/2/69": datetime(1969, 2, 1),
        "05-Jan-2001": datetime(2001, 1, 5), "05/jan/2001": datetime(2001, 1, 5), "5 JAN 2001": datetime(2001, 1, 5), "1 January 2000": datetime(2000, 1, 1), "20000201": datetime(2000, 2, 1), "123456": datetime(1234, 5, 6), "2000": datetime(2000, 1, 1),
        "2000-02-01T10:11:12": datetime(2000, 2, 1, 10, 11, 12), "2000-02-01 10:11:12+07:00": datetime(2000, 2, 1, 10, 11, 12),
        "không phải ngày": None, "": None, "today": None, "10:30": None, "30/02/2000": None, "3": None, "2,5": None, "1.234": None, "1.000.000": None, "0912345678": None, "N/A": None, None: None,
    }
    assert column(spark, cases, dates.parse_date) == list(cases.values())


def test_excel_dates(spark):
    df = spark.createDataFrame([(0.5,), (36557.0,), (1e12,), (None,)], "d double").select(dates.excel_date(F.col("d")).alias("r"))
    assert [r.r for r in df.collect()] == [datetime(1899, 12, 30, 12), datetime(2000, 2, 1), None, None]


def test_numbers(spark):
    cases = {
        "1,000,000": 1e6, "2.500.000": 2.5e6, "500,000 ₫": 5e5, "1.234,56": 1234.56, "1,234.56": 1234.56, "(500)": -500.0, "(-5)": 5.0, "2,5": 25.0, "1.234": 1.234, "$ 12": 12.0, "7đ": 7.0, "1e5": 1e5, "1_000": 1000.0, ".5": 0.5, "5.": 5.0, "1 000": 1000.0,
        "abc": None, "": None, "5d": None, "Đ5": None, "5 VND": None, "5%": None, "1.2,3,4": None, "1,234.5.6": None, "nan": None, "--5": None, None: None,
    }
    assert column(spark, cases, numbers.parse_number) == list(cases.values())
    assert column(spark, ["12.9", "-12.9", "1e30", None], lambda c: numbers.truncated(c.try_cast("double"))) == [12, -12, None, None]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-1e9, 1e9).map(lambda x: round(x, 2)), min_size=1, max_size=40))
def test_numbers_read_their_own_text(spark, values):
    got = column(spark, [f"{v:,.2f}" for v in values], numbers.parse_number)
    assert got == pytest.approx(values)


def test_text(spark):
    assert column(spark, ["o'neil abc-def x1y", None], text.title) == ["O'Neil Abc-Def X1Y", None]
    assert column(spark, ["\u00a0 a \x1f", " \t "], text.strip) == ["a", ""]
    assert column(spark, ["Địa chỉ", "Ma_NV", "Mã  NV", "HO-VA-TEN"], text.normalize_name) == ["đia chi", "ma nv", "ma nv", "ho va ten"]
    assert column(spark, ["ＡＢ", None], text.clean_text) == ["AB", None]


def test_types(spark):
    cases = {"2000-02-01": "date", "2000": "date", "1.500 ₫": "money", "đẹp": "unknown", "a@b.com": "email", "tên@d.vn": "email", "0912345678": "phone", "2,5": "number", "NV001": "code", "Nguyễn An": "text", " ": "unknown", None: "unknown"}
    assert column(spark, cases, infer.classify) == list(cases.values())
    rows = [("one", 0, "5"), *[("tie", i, v) for i, v in enumerate(["NV1", "x y", "NV2", "z w"])], ("noise", 0, "1,5"), ("noise", 1, "ab"), ("noise", 2, "a b")]
    got = {r.name: r.inferred for r in infer.infer_types(spark.createDataFrame(rows, "name string, row_idx int, value string"), ["name"]).collect()}
    assert got == {"one": "unknown", "tie": "code", "noise": "unknown"}


def test_similarity():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old = row[:]
            for j, y in enumerate(b):
                row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
        return row[-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(9))) for _ in range(2))
        assert similarity.common_length(a, b) == lcs(a, b)
    assert similarity.set_ratio("ngay thang nam sinh", "ngay sinh") == 100
    assert similarity.sort_ratio("b a", "a b") == 100
    assert round(similarity.ratio("ngay sinh", "ns"), 1) == 36.4


def test_settings_values(spark):
    assert column(spark, ["/mnt/d/foo", "D:\\foo\\b", "\\mnt\\c\\x", "/home/u"], config.to_posix) == ["/mnt/d/foo", "/mnt/d/foo/b", "/mnt/c/x", "/home/u"]
    assert column(spark, ["/mnt/d/foo", "D:\\foo"], config.to_windows) == ["D:\\foo", "D:\\foo"]
    local = ["http://localhost:1/v1"]
    assert column(spark, ["http://localhost:1/v1/", "https://x/v1"], lambda c: config.canonical_url(c, local, "http://d")) == ["http://d", "https://x/v1"]
