"""Op 6: removal of long word passages that repeat across documents, by difference-cover anchors.

Short windows are hashed only at positions that are cover positions modulo the period. For any two places of a
common passage of `length` words the cover has one shift, below the period, that makes both cover positions, so
they share an aligned anchor. Anchors found in two documents extend: the windows of `length` words around them,
and no others, are hashed whole and compared; a window is removed if a document with a smaller id has it.

Null and empty texts have no words; texts under `length` words keep all. A row with a null doc_id takes no part
and keeps all. Rows that repeat a doc_id are judged each; they never remove each other's words, as neither id is
smaller. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import buckets as B
from . import common as C

LENGTH = 50
#: Perfect difference sets by period: every residue is the difference of two members.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 31: (0, 1, 3, 8, 12, 18)}
_ANCHORS = ("<u4", "<i8", "<i8", "<u4")
_WINDOWS = ("<u8", "<u4", "<i8", "<i8", "<u4")


def period_for(length: int) -> int:
    """The largest period that leaves anchors of a third of the passage."""
    return max(p for p in COVERS if length - p + 1 >= -(-length // 3))


def word_rows(texts: list[bytes], cache: C.WordHashes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of the texts with enough words, one after the other; which texts; where each begins, and the end."""
    rows = [C.hashes(t, cache) if len(t) >= 2 * length - 1 else np.empty(0, C.U64) for t in texts]
    which = [i for i, r in enumerate(rows) if len(r) >= length]
    return np.concatenate([rows[i] for i in which]) if which else np.empty(0, C.U64), np.array(which, np.int64), np.r_[0, np.cumsum([len(rows[i]) for i in which])].astype(np.int64)


def anchored(docs: DataFrame, length: int) -> DataFrame:
    period, n = period_for(length), C.U64(B.count(docs))
    size = length - period + 1
    member = np.isin(np.arange(period), COVERS[period])
    cache = C.WordHashes()

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        ids, tags = batch.column("doc_id").to_numpy(), batch.column("tag").to_numpy()
        values, which, first = word_rows(C.as_bytes(batch.column("text")), cache, length)
        if not len(which):
            return
        sizes = np.diff(first)
        at = C.ranges(np.zeros(len(which), np.int64), sizes - size + 1)
        row = np.repeat(np.arange(len(which)), sizes - size + 1)
        on = member[at % period]
        at, row = at[on], row[on]
        start = first[row] + at
        g = C.Rolling(values).spans(start, start + size)
        doc, tag = ids[which[row]], tags[which[row]]
        order = np.lexsort((at, tag, doc, g))
        g, doc, tag, at = (x[order] for x in (g, doc, tag, at))
        cuts = B.starts_of(g)
        many = np.maximum.reduceat(doc, cuts) != np.minimum.reduceat(doc, cuts)
        shared = np.repeat(many, np.diff(np.r_[cuts, len(g)]))
        if shared.any():
            yield B.passing(doc[shared], tag[shared], at[shared])
        send = ~shared
        send[cuts] = True  # one of each shared anchor tells other batches that it exists
        yield B.packed(((g[send] >> C.U64(32)) % n).astype(np.int64), [g[send] & C.U64(0xFFFFFFFF), doc[send], tag[send], at[send]], _ANCHORS)

    return C.mapped(docs.where("doc_id is not null"), step, B.SCHEMA, 2 * C.STEP)


def meet(gram, doc, tag, at) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchors that stand in two documents."""
    order = np.lexsort((doc, gram))
    gram, doc, tag, at = (x[order] for x in (gram, doc, tag, at))
    cuts = B.starts_of(gram)
    many = np.repeat(doc[cuts] != doc[np.r_[cuts[1:] - 1, len(gram) - 1]], np.diff(np.r_[cuts, len(gram)]))
    yield doc[many], tag[many], at[many].astype(np.int64)


def windows(found: DataFrame, length: int) -> DataFrame:
    """Whole windows around shared anchors; those with a smaller document in the batch pass at once."""
    period, n = period_for(length), C.U64(B.count(found))
    cache = C.WordHashes()

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        ids, tags = batch.column("doc_id").to_numpy(), batch.column("tag").to_numpy()
        values, which, first = word_rows(C.as_bytes(batch.column("text")), cache, length)
        if not len(which):
            return
        words = batch.column("words").to_pylist()
        marked = np.zeros(len(values) + 1, np.int64)
        for k, i in enumerate(which.tolist()):
            marked[first[k] + np.array(words[i], np.int64) + 1] = 1
        marked = np.cumsum(marked)
        sizes = np.diff(first)
        start = C.ranges(first[:-1], sizes - length + 1)
        row = np.repeat(np.arange(len(which)), sizes - length + 1)
        on = marked[start + period] > marked[start]
        start, row = start[on], row[on]
        if not len(start):
            return
        g, check = C.Rolling(values).spans(start, start + length), C.Rolling(C.mix(values), 1).spans(start, start + length)
        doc, tag, at = ids[which[row]], tags[which[row]], start - first[row]
        order = np.lexsort((doc, check, g))
        g, check, doc, tag, at = (x[order] for x in (g, check, doc, tag, at))
        cuts = B.starts_of(g, check)
        later = doc > np.repeat(doc[cuts], np.diff(np.r_[cuts, len(g)]))
        if later.any():
            yield B.passing(doc[later], tag[later], at[later])
        g, check, doc, tag, at = (x[~later] for x in (g, check, doc, tag, at))
        yield B.packed(((check >> C.U64(32)) % n).astype(np.int64), [g, check & C.U64(0xFFFFFFFF), doc, tag, at], _WINDOWS)

    return C.mapped(found, step, B.SCHEMA, 2 * C.STEP)


def later(g, check, doc, tag, at) -> Iterator[tuple[np.ndarray, ...]]:
    """Windows that a document with a smaller id has too."""
    order = np.lexsort((doc, check, g))
    g, check, doc, tag, at = (x[order] for x in (g, check, doc, tag, at))
    cuts = B.starts_of(g, check)
    after = doc > np.repeat(doc[cuts], np.diff(np.r_[cuts, len(g)]))
    yield doc[after], tag[after], at[after].astype(np.int64)


def deduped(docs: DataFrame, length: int = LENGTH, kept: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; with kept: the kept words and the removed spans (in words) too."""
    keyed = C.keyed(docs, several=C.several(docs))
    anchors = C.staged(B.resolved(anchored(keyed, length), _ANCHORS, meet), "anchors", large=True)
    near = C.marked(keyed, anchors)[0].join(B.by_document(anchors).hint("merge"), ["doc_id", "tag"])
    found = C.staged(B.resolved(windows(near, length), _WINDOWS, later), "removed", large=True)

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        out = {n: [] for n in ("n_words", "n_removed", "kept_sha256", "starts", "ends", "kept")}
        for text, marks in zip(C.as_bytes(batch.column("text")), batch.column("words").to_pylist(), strict=True):
            words = text.split()
            at = np.array(marks or [], np.int64)
            s, e = C.merged(at, at + length)
            rest = [w for a, b in zip([0, *e.tolist()], [*s.tolist(), len(words)], strict=True) for w in words[a:b]] if len(s) else words
            joined = b" ".join(rest)
            for n, v in zip(out, (len(words), len(words) - len(rest), hashlib.sha256(joined).hexdigest(), s, e, joined.decode()), strict=True):
                out[n].append(v)
        yield out | {"doc_id": batch.column("doc_id")}

    return C.mapped(B.with_marks(keyed, found), step, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", starts array<long>, ends array<long>, kept string" * kept)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduped(C.table(spark, sf_dir, "documents"))


#: Every window of 50 words of every document.
OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(w[i : i + 49], ' ')) AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
firsts AS (SELECT p, min(doc_id) AS first_doc FROM win GROUP BY p),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM win JOIN firsts USING (p) WHERE first_doc < doc_id),
lists AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS x FROM d),
rest AS (SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS kept FROM word ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(len(ks), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN lists USING (doc_id) LEFT JOIN rest USING (doc_id)
"""
