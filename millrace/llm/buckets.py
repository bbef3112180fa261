"""Rows packed by bucket: one shuffled row per batch and bucket, holding columns of numbers one after the other.

A bucket below zero holds marks that need no partner: they only pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SCHEMA = "bucket int, payload binary"
MARKS = "doc_id long, tag long, word long"
MARK_TYPES = ("<i8", "<i8", "<i8")


def count(df: DataFrame) -> int:
    """Buckets: several for each shuffle partition, so that one holds a bounded share of it."""
    return max(256, 4 * C.partitions(df.sparkSession))


def packed(bucket: np.ndarray, columns: list[np.ndarray], types: tuple[str, ...], by: np.ndarray | None = None) -> dict:
    """by: an order within a bucket in which the columns compress well."""
    order = np.argsort(bucket, kind="stable") if by is None else np.lexsort((by, bucket))
    bucket, columns = bucket[order], [c[order].astype(t) for c, t in zip(columns, types, strict=True)]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, np.int64)
    ends = [*cuts[1:].tolist(), len(bucket)]
    return {"bucket": bucket[cuts].astype(np.int32), "payload": [b"".join(planes(c[a:b]) for c in columns) for a, b in zip(cuts.tolist(), ends, strict=False)]}


def planes(column: np.ndarray) -> bytes:
    """First bytes of all numbers, then second bytes and so on: small and sorted numbers compress better so."""
    return column.view(np.uint8).reshape(len(column), -1).T.tobytes()


def passing(doc: np.ndarray, tag: np.ndarray, word: np.ndarray) -> dict:
    """Marks known on the map side, dealt out by their document."""
    return packed(-1 - (C.mix(doc.astype(C.U64)) % C.U64(256)).astype(np.int64), [doc, tag, word], MARK_TYPES, by=doc)


def unpacked(payloads: list[bytes], types: tuple[str, ...]) -> list[np.ndarray]:
    kinds = [np.dtype(t) for t in types]
    width, parts = sum(k.itemsize for k in kinds), [[] for _ in kinds]
    for p in payloads:
        n, at = len(p) // width, 0
        for k, own in zip(kinds, parts, strict=True):
            own.append(np.ascontiguousarray(np.frombuffer(p, np.uint8, n * k.itemsize, at).reshape(k.itemsize, n).T).view(k).ravel())
            at += n * k.itemsize
    return [np.concatenate(own) for own in parts]


def resolved(packs: DataFrame, types: tuple[str, ...], solve: Callable[..., Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]) -> DataFrame:
    """Marks (doc_id, tag, word) that solve yields for each whole bucket, and those that pass."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(MARKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in C.groups(batches, "bucket"):
            payloads = rows.column("payload").to_pylist()
            for doc, tag, word in [tuple(unpacked(payloads, MARK_TYPES))] if bucket < 0 else solve(*unpacked(payloads, types)):
                if len(doc):
                    yield C.record({"doc_id": doc, "tag": tag, "word": word}, arrow)

    n = C.partitions(packs.sparkSession)
    return packs.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, MARKS)


def by_document(marks: DataFrame) -> DataFrame:
    """doc_id, tag, words: the marks of one document (as many as it has positions at most)."""
    return marks.groupBy("doc_id", "tag").agg(F.collect_list("word").alias("words"))


def with_marks(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """docs with the words of their marks, null without any; only texts that may have marks are shuffled."""
    near, rest = C.marked(docs, marks)
    joined = near.join(by_document(marks).hint("merge"), ["doc_id", "tag"], "left").select(*docs.columns, "words")
    return joined.union(rest.withColumn("words", F.lit(None).cast("array<long>")))


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """First rows of runs of equal keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def repeats(keys: tuple[np.ndarray, ...], place: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by keys, then place: the first of each key; those after it at another place."""
    cuts = starts_of(*keys)
    head = np.repeat(cuts, np.diff(np.r_[cuts, len(keys[0])]))
    first = np.zeros(len(head), bool)
    first[cuts] = True
    same = np.ones(len(head), bool)
    for c in place:
        same &= c == c[head]
    return first, ~same
