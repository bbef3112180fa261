"""Each operator on nulls, very long texts, repeated rows, empty tables and extra columns whose names clash with its own."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import bpe, common, decontaminate, html, jaccard, licenses, linechunks, neighbours, quality, substrings, suffixes

rng = np.random.default_rng(21)
WORDS = ["alpha", "beta", "gamma", "délta", "the", "of", "zeta", "License", "mit", "general", "public"]


def prose(n):
    return " ".join(rng.choice(WORDS, n))


LONG = prose(220_000)  # over a megabyte, more than one step
SHARED = prose(60)
ROWS = [(1, LONG), (2, f"own start {SHARED}"), (2, f"own start {SHARED}"), (3, None), (None, SHARED), (4, ""), (5, f"{SHARED}\n{LONG[:3000]}"), (5, "another text of one id"), (6, "x" * 40_000)]
CLASHING = "n_words long, n_hit long, words array<long>, word long, key long, chunk binary, bucket int, payload binary, gram long, n long, node long, root long, a long, b long, items array<string>, starts array<long>, p double, host string, h long, carry string, again boolean, ids array<long>, at long, sign array<long>, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    """The rows with thirty more columns, named as the operators name theirs."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    for c in CLASHING.split(", "):
        name, kind = c.split(" ")
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df.repartition(2)


def plain(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


def rows_of(df):
    return sorted(map(repr, df.collect()))


OPERATORS = {
    "licenses": licenses.scanned,
    "jaccard": jaccard.linked,
    "bpe": lambda df: bpe.bpe(df, texts=False),
    "substrings": substrings.deduped,
    "linechunks": linechunks.deduped,
    "suffixes": suffixes.repeated,
    "decontaminate": lambda df: decontaminate.decontaminated(df, df.sparkSession.createDataFrame([("1", SHARED), (None, "x")], "item_id string, text string")),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_columns_that_clash(spark, docs, name):
    """Extra columns change nothing; every row has its row in the result."""
    found = rows_of(OPERATORS[name](docs))
    assert len(found) == len(ROWS)
    assert found == rows_of(OPERATORS[name](plain(spark)))


def test_pages_that_clash(spark):
    pages = spark.createDataFrame([(1, "<p>a", "b", "c"), (None, None, "b", "c"), (1, "<p>a", "b", "c")], "page_id long, html string, text string, extracted string")
    assert sorted((r.page_id or 0, r.text) for r in html.extracted(pages).collect()) == [(0, ""), (1, "a"), (1, "a")]
    assert html.extracted(pages.where("false")).count() == 0
    assert html.extracted(spark.createDataFrame([(1, "<p>" + "word " * 300_000)], "page_id long, html string")).first().text == " ".join(["word"] * 300_000)


def test_vectors_that_clash(spark):
    vectors = [(i, rng.normal(size=5).tolist()) for i in range(300)] + [(0, None)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    more = df.selectExpr("*", "1 as id", "'x' as vector", "2 as best", "3 as query", "true as asked", "4 as key", "5 as v")
    assert rows_of(neighbours.searched(more)) == rows_of(neighbours.searched(df))


def test_quality_that_clashes(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (6, 0, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    more = labels.selectExpr("*", "'x' as text", "1 as junk", "2 as n")
    found = quality.classified(docs.drop("junk"), more).collect()
    assert len(found) == len(ROWS) and all(0 <= r.score <= 1 for r in found)
    same = [r for r in found if r.doc_id == 2]
    assert len(same) == 2 and same[0] == same[1]  # repeated rows have one score


def test_ties_of_templates(spark):
    """Templates with the same words, and one label twice: all are found, the label once, the score is the largest."""
    templates = (("b", "line", "one two three"), ("a", "line", "three two one"), ("b", "line", "one two"))
    df = spark.createDataFrame([(1, "ONE, two; three"), (2, "one two"), (3, "two")], "doc_id long, text string")
    assert {r.doc_id: (r.labels, r.score) for r in licenses.scanned(df, templates, (), 0.6).collect()} == {1: ("a,b", 1.0), 2: ("a,b", 1.0), 3: ("", 0.0)}


def test_long_text_of_licenses(spark):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", LONG.lower())
    places = [i for i in range(len(words)) if words[i : i + 2] == ["mit", "license"] or words[i : i + 3] == ["general", "public", "license"]]
    r = licenses.scanned(plain(spark).where("doc_id = 1")).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(places), max(places))


def test_long_text_of_benchmarks(spark):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", LONG.lower())
    items = [("far", " ".join(words[200_000:200_030])), ("near", " ".join(words[:10])), ("not", "nowhere " + " ".join(words[:8]))]
    r = decontaminate.decontaminated(plain(spark).where("doc_id = 1"), spark.createDataFrame(items, "item_id string, text string"), kept=True).first()
    assert r["items"] == ["far", "near"] and r.n_hit == 40 and r.starts == [0, 200_000] and r.ends == [10, 200_030]
    assert len(r.text.split()) == len(words) - 40


def test_phrases_of_many_items(spark, monkeypatch):
    """Equal phrases of different items and lengths name all of them; lots and blocks change nothing."""
    base = prose(40).split()
    items = [(str(i), " ".join(base[i % 7 : i % 7 + 4 + i % 13])) for i in range(60)] + [("3", " ".join(base[:12])), (None, " ".join(base))]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(base[::-1])), (3, " ".join(base[3:9]))], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    want = {}
    for r in docs.collect():
        w, hit, named = fold(r.text), set(), set()
        for item, t in items:
            p = fold(t)
            for i in range(max(1, len(p) - 9)):
                for k in range(len(w) - len(p[i : i + 10]) + 1):
                    if w[k : k + len(p[i : i + 10])] == p[i : i + 10]:
                        hit |= set(range(k, k + len(p[i : i + 10])))
                        named |= {item} - {None}
        want[r.doc_id] = len(hit), sorted(named)
    for lot, size in ((1 << 16, 8 << 20), (3, 200)):
        monkeypatch.setattr(decontaminate, "LOT", lot)
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        assert {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.decontaminated(docs, bench).collect()} == want


def test_bpe_of_repeats_and_long_words(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    letters = "".join(rng.choice(list("etaoinshr"), 30_000))
    rows = [*ROWS[1:], (7, letters), (8, "é" * 6000 + " " + letters[:401]), (9, letters[:400]), (9, letters[:400])]
    got = bpe.bpe(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = sorted((d or 0, hashlib.sha256(np.array(lib.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for d, t in rows)
    assert sorted((r.doc_id or 0, hashlib.sha256(r.ids).hexdigest()) for r in got) == want


def test_long_lines(spark):
    line = prose(60_000)
    rows = [(1, f"a\nb\n{line}\n{line}\nc"), (2, f"a\nb\n{line}\n{line}\nc"), (3, line)]
    found = {r.doc_id: r for r in linechunks.deduped(spark.createDataFrame(rows, "doc_id long, text string"), kept=True, joined=True).collect()}
    assert found[1].n_removed == 0 and found[2].n_removed == 5 and found[2].text == "" and found[3].text == line


def test_bitmap_of_documents(spark, monkeypatch):
    """Documents that may be among the nodes and the rest are all of them; no node is in the rest, however few bits there are."""
    docs = spark.range(2000).selectExpr("if(id = 7, null, id) as doc_id", "cast(id as string) as text")
    nodes = spark.range(0, 2000, 3).selectExpr("id as doc_id")
    for bits in (1 << 25, 1 << 16, 1 << 3):
        monkeypatch.setattr(common, "BITMAP", bits)
        near, rest = common.marked(docs, nodes)
        assert near.union(rest).distinct().count() == 2000
        assert rest.join(nodes, "doc_id").count() == 0
    monkeypatch.setattr(common, "BITMAP", 1 << 25)
    near, rest = common.marked(docs, nodes.where("false"))
    assert near.count() == 0 and rest.count() == 2000


@pytest.mark.parametrize("length", [100, 101, 33])
def test_ranks_over_stretches(spark, monkeypatch, length):
    """Doubling where a document's positions are dealt out in short stretches."""
    monkeypatch.setattr(suffixes, "STRETCH", 4)
    base = prose(200)
    near = base[:300] + "#" + base[301:700] + "##" + base[700:]
    rows = [(1, base), (2, near), (3, near[100:900]), (3, near[100:900]), (4, base[150:600] + prose(30) + base[150:600])]
    seen, want = set(), {}
    for d, t in sorted(set(rows)):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = True
            seen.add(b[p : p + length])
        want[d] = int(gone.sum())
    got = {r.doc_id: r.n_removed for r in suffixes.repeated(spark.createDataFrame(rows, "doc_id long, text string"), length).collect()}
    assert got == want


def test_signatures_keep_every_link(spark):
    """Sizes around a power of two, where one signature is twice as long as the other."""
    words = [f"w{i}" for i in range(1100)]
    rows = [(i, " ".join(words[: 1010 + 6 * i])) for i in range(12)] + [(50 + i, " ".join(words[: 2040 // 2 + i])) for i in range(4)]
    found = jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string"), 1, 85).collect()
    assert {r.component_id for r in found} == {0}
    assert {r.component_id for r in jaccard.linked(spark.createDataFrame([(1, "a b c"), (2, "a x y"), (3, "q r s")], "doc_id long, text string"), 1, 20).collect()} == {1, 3}


def test_stages_on_clashing_columns(spark, docs, sf_dir):
    """Every stage takes along columns named as the operators name theirs."""
    for stage in (corpus_pipeline.good_documents, corpus_pipeline.distinct_lines, corpus_pipeline.one_of_each, corpus_pipeline.clean_of_benchmarks):
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and 0 < out.count() <= len(ROWS)
    assert corpus_pipeline.encoded(spark, docs, sf_dir).count() == len(ROWS)
