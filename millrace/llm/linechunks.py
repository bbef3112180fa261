"""Op 7: removal of repeated line chunks with content-defined boundaries.

A rolling hash over the hashes of two neighbouring lines says where a chunk ends, so an inserted or dropped line
moves only the boundaries beside it. Chunks of two lines or more whose hash is found twice are fetched and
compared byte by byte; all but the first of equal chunks (smallest doc_id, then place) are removed.

A chunk of one line is never looked up by itself. With joined, as the pipeline has it, chunks with such lines joined
to their neighbours are looked up besides, so a copy of a whole document of two lines or more loses every line. The
query keeps to single chunks, as OP7_SQL does.

Lines end at "\\n". Null and empty texts have no lines. A chunk of white space only is never removed. A row with a
null doc_id takes no part and keeps all. Rows that repeat doc_id and text are one document, each returned; with
other text they are parts of it, in the order of a tag of their text. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import buckets as B
from . import common as C

#: One boundary in so many lines, on average.
PERIOD = 4
_CHUNKS = ("<u8", "<i8", "<i8", "<u4")


def chunks(text: bytes, period: int) -> tuple[list[bytes], list[tuple[int, int]]]:
    """Lines, and [from, to) of each chunk."""
    if not text:
        return [], []
    lines = text.split(b"\n")
    own = [int.from_bytes(hashlib.md5(x).digest()[:4], "big") for x in lines]
    ends = [i + 1 for i in range(1, len(lines)) if (own[i - 1] * 31 + own[i]) % 1_000_003 % period == 0]
    if not ends or ends[-1] != len(lines):
        ends.append(len(lines))
    return lines, list(zip([0, *ends], ends, strict=False))


def spans_of(text: bytes, period: int, joined: bool) -> tuple[list[bytes], list[tuple[int, int]]]:
    """chunks(); with joined: by place, those too in which a line alone is joined to the chunk after it, or else before."""
    lines, spans = chunks(text, period)
    if not joined or not spans:
        return lines, spans
    wide, start = [], 0
    for _, end in spans:
        if end - start > 1:
            wide.append((start, end))
            start = end
    if wide and start < len(lines):
        wide[-1] = wide[-1][0], len(lines)
    return lines, sorted({*spans, *wide})


def shared(keyed: DataFrame, period: int, joined: bool) -> DataFrame:
    """Marks of chunks whose hash occurs twice."""
    n = C.U64(B.count(keyed))

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        key, doc, tag, at = [], [], [], []
        for d, t, text in zip(batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist(), C.as_bytes(batch.column("text")), strict=True):
            lines, spans = spans_of(text, period, joined)
            for k, (a, b) in enumerate(spans):
                if b - a > 1 and (whole := b"\n".join(lines[a:b])).strip():
                    key.append(xxhash.xxh3_64_intdigest(whole))
                    doc.append(d)
                    tag.append(t)
                    at.append(k)
        if key:
            key, doc, tag, at = np.array(key, C.U64), np.array(doc, np.int64), np.array(tag, np.int64), np.array(at, np.int64)
            order = np.argsort(key, kind="stable")
            key, doc, tag, at = (x[order] for x in (key, doc, tag, at))
            cuts = B.starts_of(key)
            counts = np.diff(np.r_[cuts, len(key)])
            many = np.repeat(counts > 1, counts)
            if many.any():
                yield B.passing(doc[many], tag[many], at[many])
            send = ~many
            send[cuts] = True  # one of each tells other batches that it exists
            yield B.packed((key[send] % n).astype(np.int64), [key[send], doc[send], tag[send], at[send]], _CHUNKS, by=doc[send])

    return C.mapped(keyed.where("doc_id is not null"), step, B.SCHEMA, 2 * C.STEP)


def twice(key, doc, tag, at) -> Iterator[tuple[np.ndarray, ...]]:
    order = np.argsort(key, kind="stable")
    cuts = B.starts_of(key[order])
    counts = np.diff(np.r_[cuts, len(key)])
    many = order[np.repeat(counts > 1, counts)]
    yield doc[many], tag[many], at[many].astype(np.int64)


def fetched(found: DataFrame, period: int, joined: bool) -> DataFrame:
    """Bytes of the marked chunks; chunk null: a copy of an earlier one in the batch, which needs no comparison."""

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        rows = sorted(zip(batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist(), C.as_bytes(batch.column("text")), batch.column("words").to_pylist(), strict=True), key=lambda r: r[:2])
        seen, out, last = set(), [], None
        for doc, tag, text, words in rows:
            lines, spans = spans_of(text, period, joined)
            for k in sorted(set(words)):
                whole = b"\n".join(lines[slice(*spans[k])])
                key = xxhash.xxh3_64_intdigest(whole)
                out.append((key - (1 << 63), doc, tag, k, None if whole in seen and (doc, tag) != last else whole))
                seen.add(whole)
            last = doc, tag
        yield dict(zip(("key", "doc_id", "tag", "word", "chunk"), zip(*out, strict=True), strict=True))

    return C.mapped(found, step, "key long, doc_id long, tag long, word long, chunk binary", 2 * C.STEP)


def compared(rows: DataFrame) -> DataFrame:
    """Marks of the chunks that equal an earlier one; reads the sorted rows as a stream and holds one chunk a hash."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(B.MARKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, texts = None, {}
        for batch in batches:
            docs, tags, words = [], [], []
            for key, doc, tag, word, chunk in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "tag", "word", "chunk")), strict=True):
                if key != last:
                    last, texts = key, {}
                if texts.setdefault(chunk, (doc, tag, word)) != (doc, tag, word):
                    docs.append(doc)
                    tags.append(tag)
                    words.append(word)
            yield C.record({"doc_id": docs, "tag": tags, "word": words}, arrow)

    spark = rows.sparkSession
    alone = rows.where("chunk is not null").repartition(C.partitions(spark), "key").sortWithinPartitions("key", "doc_id", "tag", "word").mapInArrow(run, B.MARKS)
    return alone.union(rows.where("chunk is null").select("doc_id", "tag", "word"))


def deduped(docs: DataFrame, period: int = PERIOD, kept: bool = False, carry: list[str] | None = None, joined: bool = False) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256; with kept: the rest of the text too; carry: columns of docs to take along; joined: see above."""
    several = C.several(docs)
    keyed = C.keyed(docs, several=several)
    marks = C.staged(B.resolved(shared(keyed, period, joined), _CHUNKS, twice), "chunks", large=True)
    # merge joins at every size: sides that happen to be small today are no reason for another plan
    near = C.marked(keyed, marks)[0].join(B.by_document(marks).hint("merge"), ["doc_id", "tag"])
    rows = C.staged(fetched(near, period, joined), "fetched", large=True)
    found = C.staged(compared(rows), "removed", large=True)

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        out = {n: [] for n in ("n_lines", "n_removed", "kept_sha256", "text")}
        for text, words in zip(C.as_bytes(batch.column("text")), batch.column("words").to_pylist(), strict=True):
            gone = set(words or ())
            lines, spans = spans_of(text, period, joined) if gone else (text.split(b"\n") if text else [], [])
            cut = {i for k in gone for i in range(*spans[k])}
            rest = [x for i, x in enumerate(lines) if i not in cut] if gone else lines
            whole = b"\n".join(rest)
            for n, v in zip(out, (len(lines), len(lines) - len(rest), hashlib.sha256(whole).hexdigest(), whole.decode()), strict=True):
                out[n].append(v)
        yield out | {"doc_id": batch.column("doc_id")} | C.taken(batch)

    frame = B.with_marks(C.keyed(docs, carry=carry, several=several), found)
    return C.mapped(frame, step, C.carried("doc_id long, n_lines long, n_removed long, kept_sha256 string" + ", text string" * kept, frame))


def op7_linechunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduped(C.table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE coalesce(text, '') <> ''),
h AS (SELECT *, cast('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h FROM l),
e AS (SELECT *, coalesce((lag(h) OVER (PARTITION BY doc_id ORDER BY i) * 31 + h) % 1000003 % 4 = 0, false) AS ends FROM h),
c AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM e),
g AS (SELECT doc_id, k, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS whole FROM c GROUP BY doc_id, k),
r AS (SELECT doc_id, k, row_number() OVER (PARTITION BY whole ORDER BY doc_id, k) > 1 AS again FROM g WHERE n > 1 AND trim(whole, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''),
m AS (SELECT c.doc_id, c.i, c.line, coalesce(again, false) AS gone FROM c LEFT JOIN r USING (doc_id, k)),
t AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, cast(coalesce(n_lines, 0) AS BIGINT) AS n_lines, cast(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN t USING (doc_id)
"""
