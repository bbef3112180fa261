import pytest
from pyspark.sql import functions as F

from millrace.operators import header
from millrace.plans import stores
from millrace.plans.model import Template, TemplateColumn
from millrace.plans.pipeline import read_records, standardize_records
from millrace.plans.review import proposed
from millrace.sources import documents
from millrace.sources.files import BackendMissing, grids

TEMPLATE = Template((TemplateColumn("Ho ten"), TemplateColumn("Tuoi", data_type="int")), "t.xlsx")


def test_words_to_a_table(spark):
    words = [("f", 1, "Trang", 0.0, 20.0, 1.0)] + [("f", 1, w, x, x + 15.0, y) for y, row in ((12.0, [("Ho", 0.0), ("ten", 20.0), ("Tuoi", 80.0), ("Que", 150.0)]), (31.0, [("An", 0.0), ("30", 80.0), ("Hue", 150.0)])) for w, x in row]
    df = spark.createDataFrame(words, "source_path string, page int, text string, x0 double, x1 double, top double")
    recs, names = documents.table_records(documents.word_documents(df))
    assert names.first().names == ["Ho ten", "Tuoi", "Que"]
    out = standardize_records(recs, names, TEMPLATE)
    assert [tuple(r)[2:] for r in out.table.collect()] == [("An", "30")]


def test_boxes_of_two_pages(spark):
    result = [([[0, 0], [30, 0], [30, 20], [0, 20]], " Ten ", 0.9), ([[100, 0], [130, 0], [130, 20], [100, 20]], "Tuoi", 0.9), ([[0, 40], [30, 40], [30, 60], [0, 60]], "An", 0.9), ([[100, 40], [130, 40], [130, 60], [100, 60]], "30", 0.9), ([[0, 90], [1, 90], [1, 91], [0, 91]], " ", 0.9)]
    boxes = documents.boxes_of(result)
    assert len(boxes) == 4 and boxes[0] == (0.0, 10.0, 20.0, "Ten")
    df = spark.createDataFrame([("f", p, *b) for p in (1, 2) for b in boxes], "source_path string, page int, x double, y double, h double, text string")
    recs, names = documents.table_records(documents.box_documents(df))
    assert sorted((r.row_idx, r["values"]["Ten"]) for r in recs.collect()) == [(0, "An"), (1, "An")]
    assert names.first().names == ["Ten", "Tuoi"]


def test_readers_in_turn(spark):
    def broken(path, data):
        raise OSError

    reply = documents.records_reader(lambda path, data: 'Here: [{"a": 1, "b": "x"}, {"a": null, "c": ""}] done')
    read = documents.first_that_reads(None, broken, lambda p, d: iter([]), reply)
    assert list(read("x.pdf", b""))[:2] == [[("s", "a", None), ("s", "b", None), ("s", "c", None)], [("n", "1", 1.0), ("s", "x", None), None]]
    with pytest.raises(BackendMissing):
        list(documents.first_that_reads(None)("x.pdf", b""))
    with pytest.raises(ValueError, match="no table"):
        list(documents.first_that_reads(broken)("x.pdf", b""))
    assert documents.parse_records("[1, 2") == [] and documents.parse_records("none") == []
    files = spark.createDataFrame([("x.pdf", bytearray(b"1"))], "path string, content binary")
    recs, names = read_records(grids(files, documents=read))
    assert names.first().names == ["a", "b", "c"] and recs.count() == 2


def test_review(spark):
    cells = [[("s", "Ten", None), ("s", "Tuoi", None)], [("s", "An", None), ("n", "5", 5.0)]]
    grid = spark.createDataFrame([("f", "s", i, c) for i, c in enumerate(cells)], header.GRID)
    recs, names = read_records(grid)
    plain = proposed(recs, names, TEMPLATE).first()
    assert [m.source_col for m in plain.mappings][1] == "Tuoi" and not plain.from_preset
    key = names.select(stores.preset_key(F.lit("t.xlsx"), F.col("names")).alias("key"))
    preset = key.select("key", F.array(F.struct(F.lit("Ho ten").alias("template_col"), F.lit("Tuoi").alias("source_col"), F.lit("manual").alias("match_source"), F.lit(100.0).alias("confidence"))).alias("mappings"))
    kept = proposed(recs, names, TEMPLATE, stores.put_preset(spark.createDataFrame([], stores.PRESETS), preset)).first()
    assert kept.from_preset and kept.mappings[0].source_col == "Tuoi"
