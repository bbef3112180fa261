"""Training-data pipeline over the table `documents`.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all rows its predecessor kept; all but the last
return the columns of documents. A null text comes out empty of the stages that rewrite texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, common, decontaminate, jaccard, linechunks, quality


def _others(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c not in ("doc_id", "text")]


def _rewritten(docs: DataFrame, found: DataFrame, changed: str) -> DataFrame:
    """The columns of docs with the new text; n_chars follows it. A row that lost all of its words goes."""
    others = _others(docs)
    own = found.select("doc_id", "text", *([F.col(f"carry.`{c}`").alias(c) for c in others] if others else []), F.col(changed).alias("__changed")).where("__changed = 0 or text rlike '\\\\S'")
    if "n_chars" in others:
        own = own.withColumn("n_chars", F.when(F.col("__changed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return own.select(*[f"`{c}`" for c in docs.columns])


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier (9): documents that it rejects go."""
    found = quality.classified(docs, common.table(spark, sf_dir, "labels"), carry=docs.columns)
    return found.where("keep").select("carry.*")


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup (7): chunks of lines that stand in an earlier document go."""
    return _rewritten(docs, linechunks.deduped(docs, kept=True, carry=_others(docs) or None, joined=True), "n_removed")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n-gram Jaccard join (3) of five words and a similarity of 0.8: the smallest doc_id of each group stays."""
    first = jaccard.linked(docs, n=5, percent=80).where("component_id = doc_id").select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns).union(docs.where("doc_id is null"))


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (2): the removal spans are cut out. Repeated rows are each searched; a row that loses all of its
    words goes, one that had none stays; an empty benchmark changes nothing."""
    found = decontaminate.decontaminated(docs, common.table(spark, sf_dir, "benchmark"), kept=True, carry=_others(docs) or None)
    return _rewritten(docs, found, "n_hit")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE (5): doc_id, n_tokens, ids (little-endian 32-bit) and the text decoded from them. Null and empty texts have no tokens;
    repeated rows are each encoded."""
    return bpe.bpe(docs)


STAGES = [
    ("quality_classifier", good_documents),
    ("line_dedup", distinct_lines),
    ("near_duplicates", one_of_each),
    ("decontamination", clean_of_benchmarks),
    ("bpe", encoded),
]

#: Classifiers and merges aren't SQL; the tests hold run() against plain loops, stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
