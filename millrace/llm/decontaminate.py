"""Op 2: benchmark decontamination with an FM-index per shard of the documents.

The words of all test phrases are the alphabet; any other word of a document is a separator, so a shard's
sequence holds just the runs in which a phrase can occur. Phrases are searched backwards through wavelet
ranks, occurrences are located by sampled suffix positions, and overlapping ones merge to removal spans.

Null and empty texts have no words and are clean. An item without words has no phrase; the phrases of an item
with a null id count as hits but name no item. Rows that repeat a doc_id are each searched; repeated items
count once per item_id. Empty tables give empty or clean results. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .fmindex import FmIndex

#: Words of a phrase.
WINDOW = 10
#: Bytes of benchmark text in one broadcast; a larger benchmark is searched block by block. Driver and worker hold some 20 times as much.
BLOCK_BYTES = 8 << 20
#: Blocks that are searched in one chain of passes; after it the rows are written and read again.
CHAINED = 4
#: Phrases that are searched at once.
LOT = 1 << 16


class Phrases:
    """Distinct phrases of one block of the benchmark, as places in its sequence of words, by length, and the items each stands in."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.vocab: dict[bytes, int] = {}
        self.names = sorted({i for i, _ in items if i is not None})
        at = {n: k for k, n in enumerate(self.names)}
        ids, starts, lengths, owners, first = [], [], [], [], 0
        for item, text in items:
            words = C.fold(text).split()
            if not words:
                continue
            ids.append(np.fromiter((self.vocab.setdefault(w, len(self.vocab) + 1) for w in words), np.int32, len(words)))
            n = max(1, len(words) - window + 1)
            starts.append(np.arange(first, first + n))
            lengths.append(np.full(n, min(window, len(words))))
            owners.append(np.full(n, at.get(item, -1)))
            first += len(words)
        self.ids = np.concatenate(ids) if ids else np.empty(0, np.int32)
        #: Length, places, and the items (offsets and numbers) of the phrases of each length.
        self.by_length: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        if ids:
            self.group(*map(np.concatenate, (starts, lengths, owners)))
        self.least = min((n for n, *_ in self.by_length), default=0)

    def group(self, starts: np.ndarray, lengths: np.ndarray, owners: np.ndarray) -> None:
        """Equal phrases, by two 64-bit hashes, as one."""
        values = C.mix(self.ids.astype(C.U64))
        one, two = C.Rolling(values).spans(starts, starts + lengths), C.Rolling(C.mix(values), 1).spans(starts, starts + lengths)
        for n in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == n)
            own = own[np.lexsort((owners[own], two[own], one[own]))]
            new = np.r_[True, (one[own][1:] != one[own][:-1]) | (two[own][1:] != two[own][:-1])]
            which, item = np.cumsum(new) - 1, owners[own]
            named = (item >= 0) & (new | np.r_[True, item[1:] != item[:-1]])
            counts = np.bincount(which[named], minlength=int(new.sum()))
            self.by_length.append((n, starts[own][new], np.r_[0, np.cumsum(counts)], item[named]))


def hits(phrases: Phrases, words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard: spans' starts and ends (in all words, a separator after each document), documents' first words; (document, item) pairs."""
    get = phrases.vocab.get
    first = np.r_[0, np.cumsum([len(w) + 1 for w in words])]
    seq = np.zeros(first[-1] + 1, np.int64)
    for a, own in zip(first.tolist(), words, strict=False):
        seq[a : a + len(own)] = np.fromiter(map(get, own, repeat(0)), np.int64, len(own))
    edge = np.diff(np.r_[0, (seq > 0).view(np.int8), 0])
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = ends - starts >= max(1, phrases.least)
    from_, count = starts[keep], (ends - starts)[keep] + 1
    empty = np.empty(0, np.int64)
    if not phrases.by_length or not len(from_):
        return empty, empty, first, empty, empty
    place = C.ranges(from_, count)
    index = FmIndex(seq[place])
    # only phrases all of whose words the shard holds can occur
    here = np.zeros(len(phrases.vocab) + 1, bool)
    here[seq[place]] = True
    absent = np.r_[0, np.cumsum(~here[phrases.ids])]
    s, e, docs, items = [empty], [empty], [empty], [empty]
    for n, rows, offsets, named in phrases.by_length:
        may = np.flatnonzero(absent[rows + n] == absent[rows])
        for a in range(0, len(may), LOT):
            some = may[a : a + LOT]
            which, at = index.find(phrases.ids[rows[some][:, None] + np.arange(n)].astype(np.int64))
            start = place[at]
            s.append(start)
            e.append(start + n)
            doc = np.searchsorted(first, start, side="right") - 1
            pair = np.unique(doc * len(rows) + some[which])
            doc, which = pair // len(rows), pair % len(rows)
            counts = offsets[which + 1] - offsets[which]
            docs.append(np.repeat(doc, counts))
            items.append(named[C.ranges(offsets[which], counts)])
    s, e = C.merged(np.concatenate(s), np.concatenate(e))
    return s, e, first, np.concatenate(docs), np.concatenate(items)


def blocks(benchmark: DataFrame) -> list[list[tuple[str | None, bytes]]] | Iterator[list[tuple[str | None, bytes]]]:
    """Rows of the benchmark in blocks of about BLOCK_BYTES, by a hash of the item."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = 1 + int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES
    for k in range(n):
        own = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r.item, r.text.encode()) for r in own.toLocalIterator()]


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, kept: bool = False, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted strings), starts and ends of the removal spans (in words); with kept: and the rest
    of the text; carry: columns of docs to take along.

    One narrow pass per benchmark block (one block up to 8 MB of test text), without a shuffle; written and read again after every CHAINED
    blocks, so that no task holds more than a few workers and broadcasts at once.
    """
    sc = docs.sparkSession.sparkContext
    frame = C.keyed(docs, carry=carry).drop("tag").withColumns({"items": F.array().cast("array<string>"), "starts": F.array().cast("array<long>"), "ends": F.array().cast("array<long>")})
    for k, items in enumerate(blocks(benchmark)):
        if k and k % CHAINED == 0:
            frame = C.staged(frame, "searched")
        shared = sc.broadcast(Phrases(items, window))

        def step(batch: pa.RecordBatch, shared=shared) -> Iterator[dict]:
            phrases = shared.value
            texts = C.as_bytes(batch.column("text"))
            words = [C.fold(t).split() for t in texts]
            s, e, first, doc, item = hits(phrases, words)
            before = batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), batch.column("items").to_pylist()
            owner = np.searchsorted(first, s, side="right") - 1
            lo, hi = np.searchsorted(owner, np.arange(len(texts))), np.searchsorted(owner, np.arange(len(texts)), side="right")
            found: dict[int, set[str]] = {}
            for d, i in zip(doc.tolist(), item.tolist(), strict=True):
                found.setdefault(d, set()).add(phrases.names[i])
            out = {"items": [], "starts": [], "ends": []}
            for k in range(len(texts)):
                own_s, own_e = s[lo[k] : hi[k]] - first[k], e[lo[k] : hi[k]] - first[k]
                if before[0][k]:
                    own_s, own_e = C.merged(np.r_[own_s, before[0][k]].astype(np.int64), np.r_[own_e, before[1][k]].astype(np.int64))
                out["starts"].append(own_s)
                out["ends"].append(own_e)
                out["items"].append(sorted(found.get(k, set()).union(before[2][k])))
            yield out | {"doc_id": batch.column("doc_id"), "text": batch.column("text")} | C.taken(batch)

        frame = C.mapped(frame, step, C.carried("doc_id long, text string, items array<string>, starts array<long>, ends array<long>", frame))

    def last(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = C.as_bytes(batch.column("text"))
        out = {n: batch.column(n) for n in ("doc_id", "items", "starts", "ends")}
        starts, ends = batch.column("starts").to_pylist(), batch.column("ends").to_pylist()
        out["n_words"] = [len(C.fold(t).split()) for t in texts]
        out["n_hit"] = [sum(e) - sum(s) for s, e in zip(starts, ends, strict=True)]
        if kept:
            out["text"] = [without(t, s, e).decode() if s else t.decode() for t, s, e in zip(texts, starts, ends, strict=True)]
        yield out | C.taken(batch)

    return C.mapped(frame, last, C.carried("doc_id long, n_words long, n_hit long, items array<string>, starts array<long>, ends array<long>" + ", text string" * kept, frame))


def without(text: bytes, starts: list[int], ends: list[int]) -> bytes:
    """The text without the spans of words, and with one space in the place of each."""
    places = [m.span() for m in re.finditer(rb"[^ ]+", C.fold(text))]
    out, at = [], 0
    for s, e in zip(starts, ends, strict=True):
        out.append(text[at : places[s][0]])
        at = places[e - 1][1]
    return b" ".join([*out, text[at:]])


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminated(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: Every window of the benchmark against every window of the documents, as joined words.
OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT cast(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS p
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS p
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
h AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.p = bw.p AND dw.n = bw.n),
hw AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(n_hit, 0) AS BIGINT) AS n_hit, cast(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
