"""Op 5: BPE encoding and decoding with a contiguous rank array per word.

A word's parts stand side by side in one row and the ranks of adjacent pairs in another. The smallest rank
is found by a scan, the boundary between its two parts is deleted, and the ranks left and right of it are
looked up anew, until no adjacent pair has a rank. Words of one length form a rectangle, so each of these
steps is one array operation over all words that are new in a batch. Words of more than LONG letters give the same parts by a heap.

Null and empty texts have no ids and decode to the empty text; repeated rows are each encoded; other columns
of the input aren't read. Text is never cut: a very long text is only a long list of words.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common as C

_NONE = np.int64(1 << 40)
#: Letters beyond which a word is merged by itself.
LONG = 400


class WordBpe:
    """Tables of a word-end BPE vocabulary (the JSON of the tokenizers library, given as text)."""

    #: Entries of the table of words seen last, and their letters.
    MOST, HEAVIEST = 150_000, 8 << 20

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        tables = json.loads(spec)
        model, lib = tables["model"], Tokenizer.from_str(spec)
        if model["type"] != "BPE" or tables["decoder"] is not None or not model["end_of_word_suffix"]:
            raise ValueError("a BPE vocabulary with a word-end suffix and no decoder is needed")
        vocab, self.end = model["vocab"], model["end_of_word_suffix"]
        self.normal, self.split = lib.normalizer, lib.pre_tokenizer
        self.special = {t["content"]: t["id"] for t in tables["added_tokens"]}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.names = [""] * self.size
        for name, at in [*vocab.items(), *self.special.items()]:
            self.names[at] = name
        self.vocab = vocab
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        found = "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
        self.find_special = regex.compile(f"({found})") if found else None
        #: Ids of the chunks and words seen lately, and of the chunks seen before them.
        self.seen: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.weight, self.pairs = 0, None
        probe = lambda text: [w for w, _ in self.split.pre_tokenize_str(self.normal.normalize_str(text))]
        one = lambda c: (probe(c) * 2)[0] if len(probe(c)) == 1 else ""  # noqa: E731  what a letter or mark becomes
        latin = [c for c in map(chr, range(0x41, 0x180)) if c.isalpha()]  # none of them combines with a neighbour or depends on it
        self.small = {ord(c): x for c in latin if (x := one(c)) and probe(f"a{c}b") == [f"a{x}b"] and probe(f"{c}{c}") == [x + x]}
        self.letters = frozenset(map(chr, self.small))
        self.marks = {c: x for c in ".,;:!?)\"" if (x := one(c)) and probe(f"Ab{c}") == ["ab", x] and probe(f"\u00e9{c}") == [one("\u00e9"), x]}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge(self, parts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of parts, one word each, merged to the end; yields (which words, their parts)."""
        which = np.arange(len(parts))
        ranks = self.rank(parts[:, :-1], parts[:, 1:])
        while parts.shape[1] > 1 and len(parts):
            at = ranks.argmin(axis=1)  # the first of equal ranks
            least = ranks[np.arange(len(at)), at]
            if (done := least == _NONE).any():
                yield which[done], parts[done]
                go = ~done
                which, parts, ranks, at, least = which[go], parts[go], ranks[go], at[go], least[go]
                if not len(parts):
                    return
            row, n = np.arange(len(at)), parts.shape[1]
            parts[row, at] = self.made[least]
            keep = np.ones(parts.shape, bool)
            keep[row, at + 1] = False
            parts = parts[keep].reshape(len(at), n - 1)
            keep = np.ones(ranks.shape, bool)
            keep[row, at] = False
            ranks = ranks[keep].reshape(len(at), n - 2)
            left, right = at > 0, at < n - 2
            ranks[row[left], at[left] - 1] = self.rank(parts[row[left], at[left] - 1], parts[row[left], at[left]])
            ranks[row[right], at[right]] = self.rank(parts[row[right], at[right]], parts[row[right], at[right] + 1])
        if len(parts):
            yield which, parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same of one long word: ranks wait in a heap, parts are linked; rewriting a long row at each merge would take its square."""
        if self.pairs is None:
            self.pairs = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        n, made, get, size = len(parts), self.made, self.pairs.get, self.size
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        ranks = self.rank(np.array(parts[:-1], np.int64), np.array(parts[1:], np.int64))
        heap = [(r, i) for i, r in enumerate(ranks.tolist()) if r != _NONE]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or get(parts[i] * size + parts[j]) != r:
                continue  # one of the two has been merged since
            parts[i], parts[j], after[i] = int(made[r]), -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := get(parts[i] * size + parts[after[i]])) is not None:
                    heappush(heap, (x, i))
            if (k := before[i]) >= 0 and (x := get(parts[k] * size + parts[i])) is not None:
                heappush(heap, (x, k))
        return [p for p in parts if p >= 0]

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as little-endian 32-bit integers."""
        out, by_length = [b""] * len(words), {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for n, own in by_length.items():
            if n == 0:
                continue
            if n > LONG:
                for i in own:
                    out[i] = np.array(self.merge_long([*map(self.vocab.__getitem__, words[i][:-1]), self.vocab[words[i][-1] + self.end]]), "<u4").tobytes()
                continue
            for a in range(0, len(own), max(1, (1 << 18) // n)):
                some = own[a : a + max(1, (1 << 18) // n)]
                start = np.array([[*map(self.vocab.__getitem__, words[i][:-1]), self.vocab[words[i][-1] + self.end]] for i in some], np.int64)
                for which, parts in self.merge(start):
                    for k, ids in zip(which.tolist(), parts.astype("<u4"), strict=True):
                        out[some[k]] = ids.tobytes()
        return out

    def pieces(self, chunk: str) -> list[str]:
        """Words of a chunk without white space, by the vocabulary's own normalizer and splitter. Letters that they are known to
        keep together, alone or before a mark that they part from them, need no call."""
        if self.letters.issuperset(chunk):
            return [chunk.translate(self.small)]
        if chunk[-1] in self.marks and self.letters.issuperset(chunk[:-1]) and len(chunk) > 1:
            return [chunk[:-1].translate(self.small), self.marks[chunk[-1]]]
        return [w for w, _ in self.split.pre_tokenize_str(self.normal.normalize_str(chunk))]

    def learn(self, chunks: list[str]) -> None:
        """Ids of chunks; words not seen lately are merged together."""
        known, own = self.known, [*map(self.pieces, chunks)]
        new = [w for w in dict.fromkeys(w for words in own for w in words) if w not in known]
        for w, ids in zip(new, self.words(new), strict=True):
            known[w] = ids
        for chunk, words in zip(chunks, own, strict=True):
            self.seen[chunk] = known[words[0]] if len(words) == 1 else b"".join(map(known.__getitem__, words))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; the special tokens' own strings become their ids."""
        out: list[list[bytes]] = [[] for _ in texts]
        held, n = [], 0
        for i, text in enumerate(texts):
            for k, part in enumerate(self.find_special.split(text) if self.find_special and "<|" in text else [text]):
                if k % 2:
                    held.append((i, part))
                    continue
                chunks = chunks_of(part)
                for a in range(0, len(chunks), self.MOST):
                    held.append((i, chunks[a : a + self.MOST]))
                    if (n := n + len(held[-1][1])) >= self.MOST:
                        self.put(held, out)
                        held, n = [], 0
        self.put(held, out)
        return [b"".join(x) for x in out]

    def put(self, held: list, out: list[list[bytes]]) -> None:
        """Ids of at most twice MOST chunks, those not seen lately learnt together."""
        seen, old = self.seen, self.old
        new = set()
        for _, part in held:
            if not isinstance(part, str):
                new.update(part)
        new = new.difference(seen)
        again = new.intersection(old)
        seen.update((c, old[c]) for c in again)
        new = list(new.difference(again))
        self.weight += sum(map(len, new))
        self.learn(new)
        for i, part in held:
            out[i] += [self.special[part].to_bytes(4, "little")] if isinstance(part, str) else map(seen.__getitem__, part)
        # the chunks of the last while stay at hand when a table is full
        if len(seen) > self.MOST or self.weight > self.HEAVIEST:
            self.seen, self.old, self.weight = {}, seen if self.weight <= self.HEAVIEST else {}, 0
            if len(self.known) > self.MOST or not self.old:
                self.known = {}

    def decode(self, ids: bytes) -> str:
        """The library's decode without a decoder: the tokens' strings, one space apart."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ODD = regex.compile(r"[\x1c-\x1f]")
_SPACES = regex.compile(r"\p{White_Space}+")


def chunks_of(text: str) -> list[str]:
    """Runs without white space; str.split() also splits at four controls that are none."""
    return [c for c in _SPACES.split(text) if c] if _ODD.search(text) else text.split()


_loaded: dict[str, WordBpe] = {}


def loaded(spec: str) -> WordBpe:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = WordBpe(spec)
    return _loaded[key]


def vocabulary(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def bpe(docs: DataFrame, path: str | None = None, texts: bool = True) -> DataFrame:
    """doc_id, ids (binary: little-endian 32-bit), decoded. texts=False leaves digests in place of the two.

    The vocabulary file is read by the driver and broadcast (a fixed file, a few MB); one narrow pass.
    """
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        model = loaded(spec.value)
        ids = model.encode([t or "" for t in batch.column("text").to_pylist()])
        out = {"doc_id": batch.column("doc_id"), "n_tokens": [len(x) // 4 for x in ids]}
        if texts:
            yield out | {"ids": ids, "decoded": [model.decode(x) for x in ids]}
        else:
            yield out | {"ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids], "decoded_sha256": [hashlib.sha256(model.decode(x).encode()).hexdigest() for x in ids]}

    schema = "doc_id long, n_tokens long, " + ("ids binary, decoded string" if texts else "ids_sha256 string, decoded_sha256 string")
    return C.mapped(C.keyed(docs).drop("tag"), step, schema, C.STEP)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe(C.table(spark, sf_dir, "documents"), texts=False)
