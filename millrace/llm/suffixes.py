"""Op 10: removal of repeated byte strings by distributed prefix doubling.

Every position of every document is a suffix; one whose prefix of `length` bytes has an earlier equal is repeated.

Settling (32 bytes): most positions are known to be unique or repeated before any doubling. The window of `length` bytes
at a position belongs to the smallest hashed gram within it, so equal windows belong to equal grams, and one entry stands
for a run of positions. Runs with a gram of their own are unique; of runs that are equal as a whole (gram and all text
around it) all but the first are repeated. What stays open are positions where equal text begins or ends.

Doubling over the open positions, each step a Spark exchange of (rank pair, position) and a sort of the pairs within a
bucket:

* offset 25: pairs of the names of 25 bytes, at each open position and where the second half of its window begins. Equal
  pairs get one rank; positions whose pair stands alone are unique and drop out.
* offset 50: pairs of these ranks, brought together by document. Of equal pairs all but the first are repeated.

Sampling only settles runs of positions together; no position is skipped.

Null and empty texts have no bytes; texts under `length` bytes keep all. A row with a null doc_id takes no part
and keeps all. Rows that repeat doc_id and text are one document, each returned; rows that repeat a doc_id with
other text are parts of that document, in the order of a tag of their text. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import buckets as B
from . import common as C

LENGTH = 100
GRAM = 32
#: A word: 49 bits of position, 12 of further positions, 2 of kind.
SETTLED, OPEN = 1, 2
_TYPES = ("<u4", "<u4", "<u2", "<u2", "<u2", "<i8", "<i8", "<u4", "u1", "u1")
_NAMED = ("<u4", "<u2", "<u4", "<u2", "<i8", "<i8", "<u4", "u1")
_RANKED = ("<u4", "<u4", "<i8", "<i8", "<u4", "u1")
_PAIRS = ("<u4", "<u4", "<u4", "<u4", "<i8", "<i8", "<u4")
#: Bits of a stretch of a document within which rank pairs are made by one task.
STRETCH = 20


def word_of(at, more, kind):
    return (at.astype(np.int64) << 14) | (more.astype(np.int64) << 2) | kind


def fields(word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position, further positions, kind."""
    return word >> 14, (word >> 2) & 0xFFF, word & 3


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    rows = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    rows[:n] = x
    rows = rows.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def parts_of(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(document, offset, bytes) in lots of about half of STEP bytes, as a dozen arrays of 64-bit numbers are made of each; parts of
    a long text overlap by length - 1."""
    lot, size, most = [], 0, C.STEP // 2
    for d, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, most):
            lot.append((d, at, text[at : at + most + length - 1]))
            if (size := size + len(lot[-1][2])) >= most:
                yield lot
                lot, size = [], 0
    if lot:
        yield lot


def anchors(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one smallest gram.

    Hashes of the gram, of the run's whole text, of the text left and right of the gram (half of what a window
    holds beside it); document, first position, further positions, distance of the gram from the first.
    """
    half = -(-(length - gram) // 2)
    out = []
    for lot in parts_of(texts, length):
        sizes = np.array([len(p) for _, _, p in lot])
        first = np.r_[0, np.cumsum(sizes)[:-1]]
        data = np.frombuffer(b"".join(p for _, _, p in lot), np.uint8)
        grams = C.Rolling(C.BYTE_VALUES[0][data]).every(gram)
        low = C.U64(0xFFFFFFFF)
        least = sliding_min((grams & ~low) | np.arange(len(grams), dtype=C.U64), length - gram + 1)
        at = C.ranges(first, sizes - length + 1)
        anchor = (least[at] & low).astype(np.int64)
        start = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)])
        end = np.r_[start[1:], len(at)] - 1
        lo, hi, anchor = at[start], at[end], anchor[start]
        whole = C.Rolling(C.BYTE_VALUES[1][data], 1).spans(lo, hi + length) ^ C.mix(((hi - lo) * 65536 + (anchor - lo)).astype(C.U64))
        part = np.searchsorted(first, lo, side="right") - 1
        sides, edge = C.Rolling(C.BYTE_VALUES[0][data]), anchor + gram
        left = sides.spans(np.maximum(anchor - half, first[part]), anchor)
        right = sides.spans(edge, np.minimum(edge + half, first[part] + sizes[part]))
        doc, offset = np.array([d for d, _, _ in lot]), np.array([o for _, o, _ in lot])
        out.append((grams[anchor], whole, left, right, doc[part], lo - first[part] + offset[part], hi - lo, anchor - lo))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (*[np.empty(0, C.U64)] * 4, *[np.empty(0, np.int64)] * 4)


def anchored(docs: DataFrame, length: int, gram: int) -> DataFrame:
    n = C.U64(B.count(docs))

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        ids, tags = batch.column("doc_id").to_numpy(), batch.column("tag").to_numpy()
        g, whole, left, right, doc, at, more, to_gram = anchors(C.as_bytes(batch.column("text")), length, gram)
        doc, tag = ids[doc], tags[doc]
        order = np.lexsort((at, tag, doc, whole, g))
        g, whole, left, right, doc, tag, at, more, to_gram = (x[order] for x in (g, whole, left, right, doc, tag, at, more, to_gram))
        first, rest = B.repeats((g, whole), (doc, tag, at))  # copies within the batch are settled before the shuffle
        if rest.any():
            yield B.passing(doc[rest], tag[rest], word_of(at[rest], more[rest], SETTLED))
        if first.any():
            low, bits = C.U64(0xFFFFFFFF), C.U64(32)
            columns = [g & low, whole & low, whole >> C.U64(48), left & C.U64(0xFFFF), right & C.U64(0xFFFF), doc, tag, at, more, to_gram]
            yield B.packed(((g >> bits) % n).astype(np.int64)[first], [c[first] for c in columns], _TYPES, by=doc[first])

    return C.mapped(docs.where("doc_id is not null"), step, B.SCHEMA, 2 * C.STEP)


def settling(length: int, gram: int):
    half = -(-(length - gram) // 2)

    def settle(g, whole, high, left, right, doc, tag, at, more, to_gram) -> Iterator[tuple[np.ndarray, ...]]:
        """Of equal runs all but the first are repeated. The first stays open where its gram has other runs that agree
        on the side of the gram that a window holds half of at least."""
        whole = whole.astype(np.uint64) | (high.astype(np.uint64) << C.U64(32))
        order = np.lexsort((at, tag, doc, whole, g))
        g, whole, left, right, doc, tag, at, more, to_gram = (x[order] for x in (g, whole, left, right, doc, tag, at, more, to_gram))
        new, rest = B.repeats((g, whole), (doc, tag, at))
        yield doc[rest], tag[rest], word_of(at[rest], more[rest], SETTLED)
        g, left, right, doc, tag, at, more, to_gram = (x[new] for x in (g, left, right, doc, tag, at.astype(np.int64), more.astype(np.int64), to_gram.astype(np.int64)))
        shared = []
        for side in (left, right):
            order = np.lexsort((side, g))
            cuts = B.starts_of(g[order], side[order])
            many = np.empty(len(g), bool)
            many[order] = np.repeat(np.diff(np.r_[cuts, len(g)]) > 1, np.diff(np.r_[cuts, len(g)]))
            shared.append(many)
        # a window that starts `half` or more before the gram holds the left side, any other the right one
        lo = np.where(shared[0], 0, np.maximum(0, to_gram - half + ((length - gram) % 2 == 1)))
        hi = np.where(shared[1], more, np.minimum(more, to_gram - half))
        open_ = (lo <= hi) & (shared[0] | shared[1])
        yield doc[open_], tag[open_], word_of((at + lo)[open_], (hi - lo)[open_], OPEN)

    return settle


def halves(length: int) -> tuple[int, int]:
    """Lengths of the prefixes that are ranked before the whole: about a quarter, about a half."""
    half = -(-length // 2)
    return -(-half // 2), half


def named(open_texts: DataFrame, length: int) -> DataFrame:
    """Rank pairs of the first offset: for each open position, and the one where the second half of its window begins, the
    names of the quarter there and of the next one. Only here is the text read; names are 48-bit hashes."""
    (quarter, half), n = halves(length), C.U64(B.count(open_texts))

    def lots(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
        lot, size = [], 0
        for doc, tag, text, words in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag")), C.as_bytes(batch.column("text")), batch.column("words").to_pylist(), strict=True):
            at, more, _ = fields(np.array(words, np.int64))
            s, e = C.merged(at, at + more + length)
            places = np.unique(C.ranges(at, more + 1))
            for a, b in zip(s.tolist(), e.tolist(), strict=True):
                for k in range(a, b - length + 1, C.STEP):
                    part = text[k : min(b, k + C.STEP + length - 1)]
                    own = places[slice(*np.searchsorted(places, (k, k + len(part) - length + 1)))]  # between open positions stand settled ones
                    lot.append((doc, tag, k, part, own - k))
                    if (size := size + len(part)) >= C.STEP:
                        yield lot
                        lot, size = [], 0
        if lot:
            yield lot

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        for lot in lots(batch):
            sizes = np.array([len(x[3]) for x in lot])
            first = np.r_[0, np.cumsum(sizes)[:-1]]
            data = np.frombuffer(b"".join(x[3] for x in lot), np.uint8)
            part = np.repeat(np.arange(len(lot)), [len(x[4]) for x in lot])
            open_ = first[part] + np.concatenate([x[4] for x in lot])
            both = np.zeros(len(data), np.uint8)
            both[open_] = 1
            both[open_ + length - half] |= 2
            at = np.flatnonzero(both)
            part = np.searchsorted(first, at, side="right") - 1
            names = C.Rolling(C.BYTE_VALUES[0][data])
            left, right = names.spans(at, at + quarter), names.spans(at + half - quarter, at + half)
            doc, tag, start = (np.array([x[k] for x in lot])[part] for k in range(3))
            low, bits = C.U64(0xFFFFFFFF), C.U64(48)
            bucket = (C.mix(left ^ (right * C.U64(0x9E3779B97F4A7C15))) % n).astype(np.int64)
            yield B.packed(bucket, [left & low, left >> bits, right & low, right >> bits, doc, tag, start + at - first[part], both[at] & 1], _NAMED, by=doc)

    return C.mapped(open_texts, step, B.SCHEMA, 2 * C.STEP)


#: Positions that a task gathers before it packs them for the next exchange.
GATHERED = 1 << 20


def in_buckets(packs: DataFrame, types: tuple[str, ...], solve: Callable[..., tuple | None], to: tuple[str, ...] | None = None) -> DataFrame:
    """solve(bucket, columns) over whole buckets: a Spark exchange by bucket and a sort within it. Without `to` it gives marks; with it
    (next bucket, columns of these types, document), packed over the buckets of a task, so that a task sends a row for each next
    bucket and not one for each pair of buckets."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = B.SCHEMA if to else B.MARKS
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def packed() -> pa.RecordBatch:
            dealt, columns, doc = (np.concatenate([x[0] for x in held]), [np.concatenate(c) for c in zip(*(x[1] for x in held), strict=True)], np.concatenate([x[2] for x in held]))
            held.clear()
            return C.record(B.packed(dealt, columns, to, by=doc), arrow)

        for bucket, rows in C.groups(batches, "bucket"):
            out = solve(int(bucket), *B.unpacked(rows.column("payload").to_pylist(), types))
            if out is None:
                continue
            if to is None:
                yield C.record(dict(zip(("doc_id", "tag", "word"), out, strict=True)), arrow)
                continue
            dealt, columns, doc = out
            held.append((dealt, [c.astype(t) for c, t in zip(columns, to, strict=True)], doc))
            if sum(len(x[0]) for x in held) >= GATHERED:
                yield packed()
        if held:
            yield packed()

    return packs.repartition(C.partitions(packs.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def ranking(length: int, n: int):
    """Sorts rank pairs, gives equal ones one rank, and drops those that stand alone; the rest goes back to its document."""
    back = length - halves(length)[1]

    def rank(bucket, *columns) -> tuple | None:
        *key, doc, tag, at, open_ = columns
        order = np.lexsort(key[::-1])
        key, doc, tag, at, open_ = [k[order] for k in key], doc[order], tag[order], at[order].astype(np.int64), open_[order]
        cuts = B.starts_of(*key)
        counts = np.diff(np.r_[cuts, len(doc)])
        many = np.repeat(counts > 1, counts)
        if not many.any():
            return None
        number = np.repeat(np.arange(len(cuts)), counts)[many]
        doc, tag, at, open_ = doc[many], tag[many], at[many], open_[many]
        # a long document's positions are dealt out by stretches; one that begins a second half goes to the first half's too
        stretch = at >> STRETCH
        before = np.maximum(at - back, 0) >> STRETCH
        twice = np.flatnonzero(before != stretch)
        send = np.r_[np.arange(len(at)), twice]
        where = np.r_[stretch, before[twice]]
        dealt = (C.mix(doc[send].astype(C.U64) ^ C.mix(tag[send].astype(C.U64) + where.astype(C.U64))) % C.U64(n)).astype(np.int64)
        flag = np.r_[open_, np.zeros(len(twice), open_.dtype)]
        return dealt, [np.full(len(send), bucket), number[send], doc[send], tag[send], at[send], flag], doc[send]

    return rank


def doubling(length: int, n: int):
    """Of each stretch of a document: pairs of the ranks at an open position and at the second half of its window."""
    back = length - halves(length)[1]

    def place(doc, tag, at):
        return C.mix(doc.astype(C.U64) ^ C.mix(tag.astype(C.U64) ^ C.mix(at.astype(C.U64))))

    def pair(_, high, low, doc, tag, at, open_) -> tuple | None:
        at = at.astype(np.int64)
        key = place(doc, tag, at)
        order = np.argsort(key, kind="stable")
        key, high, low, doc, tag, at, open_ = (x[order] for x in (key, high, low, doc, tag, at, open_))
        p = np.flatnonzero(open_)
        q = np.minimum(np.searchsorted(key, place(doc[p], tag[p], at[p] + back)), len(key) - 1)
        found = (doc[q] == doc[p]) & (tag[q] == tag[p]) & (at[q] == at[p] + back)
        p, q = p[found], q[found]
        if not len(p):
            return None
        bucket = C.mix((high[p].astype(C.U64) << C.U64(32) | low[p]) ^ C.mix(high[q].astype(C.U64) << C.U64(32) | low[q])) % C.U64(n)
        return bucket.astype(np.int64), [high[p], low[p], high[q], low[q], doc[p], tag[p], at[p]], doc[p]

    return pair


def repeats_of(_, *columns) -> tuple:
    """Rank pairs sorted: a pair of its own is unique; of equal pairs all but the first are repeated."""
    *key, doc, tag, at = columns
    order = np.lexsort((at, tag, doc, *key[::-1]))
    key, doc, tag, at = [k[order] for k in key], doc[order], tag[order], at[order]
    _, again = B.repeats(tuple(key), (doc, tag, at))
    return doc[again], tag[again], word_of(at[again], np.zeros(again.sum(), np.int64), SETTLED)


def doubled(open_texts: DataFrame, length: int) -> DataFrame:
    """Marks of the open positions whose window stands earlier: ranks of a quarter, of a half, of the whole."""
    n = max(64, 2 * C.partitions(open_texts.sparkSession))
    ranked = C.staged(in_buckets(named(open_texts, length), _NAMED, ranking(length, n), _RANKED), "ranked", large=True)
    pairs = in_buckets(ranked, _RANKED, doubling(length, n), _PAIRS)
    return C.staged(in_buckets(pairs, _PAIRS, repeats_of), "again", large=True)


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with kept: the rest of the text (binary) and the spans too."""
    gram = min(length, max(gram, length - 255))
    keyed = C.keyed(docs, several=C.several(docs))
    marks = C.staged(B.resolved(anchored(keyed, length, gram), _TYPES, settling(length, gram)), "runs", large=True)
    open_ = marks.where(F.col("word").bitwiseAND(3) == OPEN)
    near = C.marked(keyed, open_)[0].join(B.by_document(open_).hint("merge"), ["doc_id", "tag"])
    again = doubled(near, length)
    found = marks.where(F.col("word").bitwiseAND(3) == SETTLED).union(again)

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        out = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends", "kept")}
        for text, words in zip(C.as_bytes(batch.column("text")), batch.column("words").to_pylist(), strict=True):
            at, more, _ = fields(np.array(words or [], np.int64))
            s, e = C.merged(at, at + more + length)
            rest = b"".join(text[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(text)], strict=True)) if len(s) else text
            row = len(text), len(text) - len(rest), len(s), hashlib.sha256(rest).hexdigest(), s, e, rest
            for n, v in zip(out, row, strict=True):
                out[n].append(v)
        yield out | {"doc_id": batch.column("doc_id")}

    return C.mapped(B.with_marks(keyed, found), step, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", starts array<long>, ends array<long>, kept binary" * kept)


#: Every string of 100 bytes of every document, as hexadecimal digits.
OP10_SQL = r"""WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
w AS (SELECT doc_id, unnest(ps) AS p, unnest(range(0, len(ps))) AS i FROM (SELECT doc_id, list_transform(range(0, len(x) // 2 - 99), lambda i: md5_number(substr(x, 2 * i + 1, 200))) AS ps FROM d WHERE len(x) >= 200)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY p ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
runs AS (SELECT doc_id, min(i) AS s, max(i) + 100 AS e FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, (i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, -1))::INT AS new FROM again)) GROUP BY doc_id, run),
cuts AS (SELECT doc_id, list(s ORDER BY s) AS ss, list(e ORDER BY s) AS es FROM runs GROUP BY doc_id),
k AS (SELECT doc_id, x, coalesce(ss, []) AS ss, coalesce(es, []) AS es FROM d LEFT JOIN cuts USING (doc_id))
SELECT doc_id, cast(len(x) // 2 AS BIGINT) AS n_bytes, cast(coalesce(list_sum(es) - list_sum(ss), 0) AS BIGINT) AS n_removed, cast(len(ss) AS BIGINT) AS n_spans,
       sha256(unhex(array_to_string(list_transform(range(0, len(ss) + 1), lambda j: substr(x, 2 * (CASE WHEN j = 0 THEN 0 ELSE es[j] END) + 1, 2 * ((CASE WHEN j = len(ss) THEN len(x) // 2 ELSE ss[j + 1] END) - (CASE WHEN j = 0 THEN 0 ELSE es[j] END)))), ''))) AS kept_sha256
FROM k
"""


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(C.table(spark, sf_dir, "documents"))
