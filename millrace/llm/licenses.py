"""Op 1: license scan as an exact set-similarity join of text blocks with templates, by containment.

Template tokens are ordered by their frequency in the corpus, rarest first. A block that holds at least
c = ceil(t * |T|) of a template's tokens holds one of its first |T| - c + 1 (prefix filter), has c tokens or more
(length filter), and from its first match on enough of the template's order is left (position filter); what is
left is counted exactly. A phrase is a template with containment 1 of which the words must stand consecutively:
its prefix is its rarest word, and each place of that word is verified.

Blocks are lines, and runs of two or three lines of a paragraph, for short notices, which may be hard-wrapped, and
paragraphs (apart by blank lines) for license texts; OP1_SQL has single lines only. Words are runs of
0-9, a-z and bytes above 0x7F after lower-casing A-Z. Null and empty texts hold nothing. Rows that repeat a
doc_id are each scanned, null ids too; other columns aren't read. Nothing is shuffled but token counts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Label, kind of block, text of public license notices.
TEMPLATES = (
    ("apache-2.0", "line", "Licensed under the Apache License, Version 2.0"),
    ("cc-by-nc-4.0", "line", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "line", "Licensed under CC BY-SA 4.0"),
    ("gpl-3.0", "line", "This work is licensed under the GNU General Public License, version 3"),
    ("mit-notice", "line", "Released under the MIT License"),
    ("mpl-2.0", "line", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("bsd-text", "paragraph", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mit-text", "paragraph", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
)
THRESHOLD = 0.85
#: Lines over which a short notice may be wrapped.
WRAPPED = 3
_PARAGRAPH = re.compile(rb"\n[ \t\r\f\v]*\n")


@dataclass
class Template:
    label: str
    unit: str
    tokens: list[bytes]
    need: int


class Scanner:
    def __init__(self, templates, phrases, threshold: float, counts: dict[bytes, int]):
        order = lambda w: (counts.get(w, 0), w)
        self.templates = []
        for label, unit, text in templates:
            if tokens := sorted(set(C.fold(text.encode()).split()), key=order):
                self.templates.append(Template(label, unit, tokens, need_of(len(tokens), threshold)))
        #: First tokens of each template, with their place in its order.
        self.prefix: dict[str, dict[bytes, list[tuple[int, int]]]] = {"line": {}, "paragraph": {}}
        for i, t in enumerate(self.templates):
            for place, token in enumerate(t.tokens[: len(t.tokens) - t.need + 1]):
                self.prefix[t.unit].setdefault(token, []).append((i, place))
        self.any = {*self.prefix["line"], *self.prefix["paragraph"]}
        self.phrases = []
        for text, label in phrases:
            words = C.fold(text.encode()).split()
            rare = min(range(len(words)), key=lambda k: order(words[k]))
            self.phrases.append((words, rare, label))

    def places(self, words: list[bytes]) -> tuple[list[int], set[str]]:
        starts, labels = [], set()
        for phrase, rare, label in self.phrases:
            at = -1
            while True:
                try:
                    at = words.index(phrase[rare], at + 1)
                except ValueError:
                    break
                if at >= rare and words[at - rare : at - rare + len(phrase)] == phrase:
                    starts.append(at - rare)
                    labels.add(label)
        return starts, labels

    def block(self, unit: str, tokens: set[bytes]) -> Iterator[tuple[int, float]]:
        """Templates that the block holds, with their containment."""
        first: dict[int, int] = {}
        for token in tokens & self.prefix[unit].keys():
            for i, place in self.prefix[unit][token]:
                first[i] = min(place, first.get(i, place))
        for i, place in first.items():
            t = self.templates[i]
            if len(tokens) >= t.need and len(t.tokens) - place >= t.need:
                both = sum(x in tokens for x in t.tokens[place:])
                if both >= t.need:
                    yield i, both / len(t.tokens)

    def scan(self, text: bytes) -> tuple[int, list[int], set[str], dict[str, float]]:
        """Number of words, places and labels of phrases, containment of each template found."""
        folded = C.fold(text)
        words = folded.split()
        starts, labels = self.places(words)
        found: dict[str, float] = {}
        if not self.any.isdisjoint(words):
            for unit, parts in (("line", runs(text)), ("paragraph", (set(C.fold(x).split()) for x in _PARAGRAPH.split(text)))):
                if self.prefix[unit]:
                    for part in parts:
                        for i, share in self.block(unit, part):
                            label = self.templates[i].label
                            found[label] = max(share, found.get(label, 0))
        return len(words), starts, labels, found


def runs(text: bytes) -> Iterator[set[bytes]]:
    """Tokens of each line, and of each run of up to WRAPPED lines without a blank one among them."""
    before: list[set[bytes]] = []
    for line in text.split(b"\n"):
        if not line.strip():
            before = []
            continue
        own = set(C.fold(line).split())
        before = [own, *(x | own for x in before[: WRAPPED - 1])]
        yield from before


def need_of(size: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


def frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """How often each template token occurs in the corpus; as many rows as the templates have tokens."""

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        counts: Counter[bytes] = Counter()
        for text in C.as_bytes(batch.column("text")):
            counts.update(filter(vocabulary.__contains__, C.fold(text).split()))
        yield {"token": list(counts), "n": list(counts.values())}

    rows = C.mapped(docs, step, "token binary, n long", 8 * C.STEP).groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.token): r.n for r in rows}


def scanned(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    templates: label, kind of block, text of each. They come with the call and are broadcast, some 100 bytes for each of their words.
    """
    words = [w for _, _, t in templates for w in C.fold(t.encode()).split()] + [w for t, _ in phrases for w in C.fold(t.encode()).split()]
    keyed = C.keyed(docs).drop("tag")
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(templates, phrases, threshold, frequencies(keyed, frozenset(words))))

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        out = {n: [] for n in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
        for text in C.as_bytes(batch.column("text")):
            n, starts, base, found = scanner.value.scan(text)
            row = n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | found.keys())), max([1.0 if starts else 0.0, *found.values()])
            for name, v in zip(out, row, strict=True):
                out[name].append(v)
        yield out | {"doc_id": batch.column("doc_id")}

    return C.mapped(keyed, step, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(C.table(spark, sf_dir, "documents"))


def _sql() -> str:
    """Every block against every template, and every place of the text against every phrase."""
    quoted = lambda words: "[" + ", ".join(f"'{w.decode()}'" for w in words) + "]"
    fold = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    phrases = ", ".join(f"('{label}', {quoted(C.fold(t.encode()).split())})" for t, label in PHRASES)
    rows = []
    for label, unit, t in TEMPLATES:
        tokens = sorted(set(C.fold(t.encode()).split()))
        rows.append(f"('{label}', '{unit}', {quoted(tokens)}, {need_of(len(tokens), THRESHOLD)})")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all({fold("coalesce(text, '')")}, {word}) AS w FROM documents),
p AS (SELECT * FROM (VALUES {phrases}) AS v(label, ws)),
b AS (SELECT doc_id, label, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) x, p WHERE w[i : i + len(ws) - 1] = ws),
bb AS (SELECT doc_id, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id),
t AS (SELECT * FROM (VALUES {", ".join(rows)}) AS v(label, unit, ws, need)),
blocks AS (SELECT doc_id, 'line' AS unit, unnest(string_split(text, chr(10))) AS part FROM d
           UNION ALL SELECT doc_id, 'paragraph', unnest(regexp_split_to_array(text, '\n[ \t\r\f\v]*\n')) FROM d),
bw AS (SELECT doc_id, unit, list_distinct(regexp_extract_all({fold("part")}, {word})) AS bs FROM blocks),
m AS (SELECT doc_id, label, max(len(list_intersect(bs, ws)) / len(ws)) AS share FROM bw JOIN t USING (unit) WHERE len(list_intersect(bs, ws)) >= need GROUP BY doc_id, label),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM b UNION SELECT doc_id, label FROM m) GROUP BY doc_id),
s AS (SELECT doc_id, max(share) AS share FROM m GROUP BY doc_id)
SELECT d.doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(n_base, 0) AS BIGINT) AS n_base, cast(first_word AS BIGINT) AS first_word, cast(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, cast(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS DOUBLE) AS score
FROM d LEFT JOIN bb USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN s USING (doc_id)
"""


OP1_SQL = _sql()
