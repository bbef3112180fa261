"""The exact operators against brute force on small tables with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import re
from itertools import combinations

import numpy as np
import pytest

from millrace.llm import bpe, common, decontaminate, fmindex, jaccard, licenses, linechunks, queries, substrings, suffixes

rng = np.random.default_rng(5)
WORDS = ["alpha", "beta", "gamma", "délta", "e", "the", "of", "and", "zeta", "eta", "Theta", "iota,", "kappa"]


def prose(n):
    return " ".join(rng.choice(WORDS, n))


def corpus():
    """Rows (doc_id, text) with shared passages, near and exact copies, repeats and edge cases."""
    shared, other = prose(80), prose(70)
    base = prose(150)
    near = base.split()
    near[70] = "changed"
    rows = [
        (1, base), (2, " ".join(near)), (3, base), (4, f"{prose(20)} {shared} {prose(30)}"), (5, f"{shared}\n{prose(9)}"), (6, f"{prose(3)} {other} {shared}"), (7, other), (8, f"{other} {other}"), (9, None), (10, ""), (11, "one two"), (12, "one two"), (13, "One TWO"),
        (14, "x" * 250), (15, "ab" * 130), (16, "ab" * 70 + "c" + "ab" * 70), (17, "é" * 90), (18, prose(49)), (19, "word " * 130), (20, base), (20, base), (21, " ".join(prose(1) for _ in range(5)) + " " + base[20:400]), (-5, base[30:500]), (22, "\n \t "), (23, f"{base} {base}"),
    ]
    return rows + [(30 + i, f"{prose(10 + i)} {shared} {prose(5)}") for i in range(12)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = [(d, t, "clash", 7, "h", b"p") for d, t in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, n_words string, bucket int, tag string, payload binary").repartition(3)


def collected(df, *cols):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, set()).add(tuple(r[c] for c in cols))
    assert all(len(v) == 1 for v in out.values())
    return {k: next(iter(v)) for k, v in out.items()}


def test_repeated_bytes(docs, rows):
    seen, want = set(), {}
    for d, t in sorted(set(rows), key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        want[d] = len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()
    found = suffixes.repeated(docs)
    assert found.count() == len(rows)
    assert collected(found, "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


@pytest.mark.parametrize("length", [101])
def test_repeated_bytes_of_other_lengths(docs, rows, length):
    seen, want = set(), {}
    for d, t in sorted(set(rows), key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = True
            seen.add(b[p : p + length])
        want[d] = (int(gone.sum()),)
    assert collected(suffixes.repeated(docs, length), "n_removed") == want


def test_parts_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(common, "STEP", 300)
    text = prose(400)
    whole = suffixes.anchors([text.encode()], 100, 32)
    lots = list(suffixes.parts_of([text.encode()], 100))
    assert len(lots) > 3 and sum((whole[6] + 1).tolist()) == len(text.encode()) - 99
    assert b" ".join(common.cut(text.encode(), 64)).split() == text.encode().split()


def judged(rows, n):
    """Of each row: doc_id, number of words, removed ones, digest of the rest."""
    words = [(d, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for d, t in rows]
    first = {}
    for d, w in sorted(words, key=lambda r: r[0]):
        for i in range(len(w) - n + 1):
            first.setdefault(tuple(w[i : i + n]), d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < d:
                gone[i : i + n] = [True] * n
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return out


def passages(rows, n):
    return {d: tuple(rest) for d, *rest in judged(rows, n)}


@pytest.mark.parametrize("length", [50, 5])
def test_repeated_passages(docs, rows, length):
    found = substrings.deduped(docs, length)
    assert found.count() == len(rows)
    assert collected(found, "n_words", "n_removed", "kept_sha256") == passages(rows, length)


def test_many_texts_under_one_id(spark):
    """Hundreds of different texts of one doc_id, some of them repeated, are each told apart."""
    shared = [prose(70) for _ in range(4)]
    texts = [" ".join([prose(int(rng.integers(0, 30))), shared[i % 4] if i % 3 else "", prose(int(rng.integers(0, 200)))]) for i in range(400)]
    rows = [(5, t) for t in texts] + [(5, texts[3]), (1, f"{shared[0]} {prose(5)}"), (9, f"{prose(4)} {shared[1]}"), (9, texts[7]), (5, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)

    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.deduped(df).collect())
    assert got == sorted(judged(rows, 50))

    order = {r.text or "": r.h for r in df.selectExpr("text", "xxhash64(coalesce(text, '')) as h").collect()}
    seen, want = set(), {}
    for d, t in sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0], order[r[1]])):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        want[d, t] = d, len(b), int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffixes.repeated(df).collect())
    assert got == sorted(want[d, t or ""] for d, t in rows)

    lines = spark.createDataFrame([(d, t and t.replace(" ", "\n")) for d, t in rows], "doc_id long, text string").repartition(4)
    found = linechunks.deduped(lines, kept=True)
    assert found.count() == len(rows)
    assert {x for _, t in rows for x in (t or "").split()} == {x for r in found.collect() for x in r.text.split()}


def test_covers():
    for period, cover in substrings.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def groups(rows, n, percent):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_components(docs, rows, n, percent):
    found = jaccard.linked(docs, n, percent)
    assert found.count() == len(rows)
    assert collected(found, "n_shingles", "component_id") == groups(rows, n, percent)


def test_a_chain_of_near_copies(spark):
    """Each text is near the next only; all are one component, and one far text stays alone."""
    words = [f"w{i}" for i in range(240)]
    rows = [(100 - k, " ".join(f"x{j}" if j % 60 == 7 and j // 60 < k else w for j, w in enumerate(words))) for k in range(4)]
    rows += [(200 - k, " ".join([*words[: 240 - 9 * k], *(f"y{k}_{j}" for j in range(9 * k))])) for k in range(4)] + [(7, prose(200))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert collected(jaccard.linked(df), "n_shingles", "component_id") == groups(rows, 4, 85)


def test_decontamination(spark, docs, rows):
    texts = dict(rows)
    items = [("a", " ".join(texts[4].split()[25:60])), ("b", "one, TWO!"), ("c", ""), ("d", None), (None, " ".join(texts[7].split()[:30])), ("10", texts[7]), ("a", "kappa nowhere"), ("e", "  Alpha  ")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = {}
    for d, t in rows:
        w, hit, named = split(t), set(), set()
        for item, text in items:
            p = split(text)
            for i in range(max(1, len(p) - 9) if p else 0):
                q = p[i : i + 10]
                for k in range(len(w) - len(q) + 1):
                    if w[k : k + len(q)] == q:
                        hit.update(range(k, k + len(q)))
                        named |= {item} - {None}
        want[d] = len(w), len(hit), tuple(sorted(named))
    found = decontaminate.decontaminated(docs, bench, kept=True)
    got = {r.doc_id: (r.n_words, r.n_hit, tuple(r["items"])) for r in found.collect()}
    assert got == want
    for r in found.collect():
        assert len(split(r.text)) == r.n_words - r.n_hit


def test_decontamination_in_blocks(spark, docs, monkeypatch):
    bench = docs.selectExpr("cast(doc_id as string) as item_id", "substring(text, 1, 300) as text").where("doc_id < 8")
    one = collected(decontaminate.decontaminated(docs, bench).selectExpr("doc_id", "n_hit", "array_join(items, ',') as items"), "n_hit", "items")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 500)
    assert collected(decontaminate.decontaminated(docs, bench).selectExpr("doc_id", "n_hit", "array_join(items, ',') as items"), "n_hit", "items") == one


def test_index():
    seq = np.r_[rng.integers(1, 5, 300), 0, rng.integers(1, 5, 200), 0]
    index = fmindex.FmIndex(seq)
    for n in (1, 2, 5):
        phrases = rng.integers(1, 7, (40, n))
        which, at = index.find(phrases)
        want = {(i, p) for i, q in enumerate(phrases.tolist()) for p in range(len(seq) - n + 1) if seq[p : p + n].tolist() == q}
        assert set(zip(which.tolist(), at.tolist(), strict=True)) == want


def test_bpe(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in bpe.bpe(docs).collect()}
    for d, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[d].ids, "<u4").tolist() == ids
        assert got[d].decoded == lib.decode(ids, skip_special_tokens=False)


def test_bpe_of_odd_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), bpe.WordBpe(bpe.vocabulary())
    texts = ["<|endoftext|>a<|startoftext|> <|endoftext", "é É ﬁ Ⅳ ½ ²", "it's I'LL '' 's", "a\x1cb\x85c d　e", "ΑΣ ΣΑΣ İI ß ẞ", "日本語 テキスト 한국어 ไทย", "🙂🙂 👩‍👩‍👧", "\0\x01", "don't12345x_y--", "ﷺ", "x" * 5000]
    texts += ["".join(map(chr, rng.integers(1, 0x2FFF, 60))) for _ in range(300)]
    own.MOST = 50
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids
        assert own.decode(ids) == lib.decode(lib.encode(t, add_special_tokens=False).ids, skip_special_tokens=False)


def test_lines(spark):
    block = "first line\nsecond line\nthird\nfourth one\nfifth"
    rows = [(1, f"{block}\nown"), (2, f"x\n{block}"), (3, block), (3, block), (4, None), (5, ""), (6, "\n\n\n\n"), (7, "\n\n\n\n"), (-1, f"{block}\n{block}\n{block}"), (8, f"{block}\n{block}"), (None, block), (9, "solo")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen, want = {}, {}
    for d, t in sorted({r for r in rows if r[0] is not None}):
        lines, spans = linechunks.chunks((t or "").encode(), linechunks.PERIOD)
        kept = []
        for k, (a, b) in enumerate(spans):
            whole = b"\n".join(lines[a:b])
            if b - a == 1 or not whole.strip() or seen.setdefault(whole, (d, k)) == (d, k):
                kept += lines[a:b]
        want[d] = len(lines), len(lines) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()
    found = linechunks.deduped(df, kept=True)
    assert found.count() == len(rows)
    got = collected(found, "n_lines", "n_removed", "kept_sha256")
    assert got.pop(None)[1] == 0
    assert got == want and sum(v[1] for v in want.values()) > 0


def test_copies_lose_every_line(spark):
    """With joined, no line of an exact copy stays, one removed by single chunks stays removed, and one copy is kept."""
    import corpus_pipeline

    texts = [f"line {i} of a text\n" * (i % 2 + 1) + "\n".join(f"{prose(4)} {i} {k}" for k in range(2 + i)) for i in range(40)]
    assert any(b - a == 1 for t in texts for a, b in linechunks.chunks(t.encode(), linechunks.PERIOD)[1])
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(texts)] + [(200 + i, f"new {i}\n{t}\nend {i}") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    single, got = collected(linechunks.deduped(df), "n_removed"), collected(linechunks.deduped(df, kept=True, joined=True), "n_lines", "n_removed", "text")
    for i, t in enumerate(texts):
        assert got[100 + i] == (t.count("\n") + 1, t.count("\n") + 1, "")
    assert all(got[d][1] >= n for d, (n,) in single.items())
    assert {x for _, t in rows for x in t.split("\n")} == {x for _, _, t in got.values() for x in t.split("\n") if x}
    assert not [r.doc_id for r in corpus_pipeline.distinct_lines(spark, df, "").collect() if 100 <= r.doc_id < 200]


def test_licenses(spark):
    rows = [(1, "x MIT License, mit\nlicense"), (2, "Released under the MIT License."), (3, "released under the license"), (4, None), (5, "general public\n\nlicense apache license"), (6, "© Licensed under the Apache License, Version 2.0!"), (7, licenses.TEMPLATES[-1][2].upper()), (7, "")]
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert got[:6] == [
        (1, 5, 2, 1, 3, "mit", "mit", 1.0), (2, 5, 1, 3, 3, "mit", "mit,mit-notice", 1.0), (3, 4, 0, None, None, "", "", 0.0), (4, 0, 0, None, None, "", "", 0.0), (5, 5, 2, 0, 3, "apache,gpl", "apache,gpl", 1.0), (6, 9, 1, 4, 4, "apache", "apache,apache-2.0", 1.0),
    ]
    assert got[6][6] == "mit-text" and got[6][7] == 1.0 and got[7][1] == 0


def test_wrapped_notices(spark):
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/."
    rows = [(1, mpl), (2, "Licensed under\nthe Apache License,\nVersion 2.0"), (3, "Released under the\n\nMIT License"), (4, "Released\nunder\nthe MIT\nLicense")]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("mpl-2.0", 1.0), 2: ("apache,apache-2.0", 1.0), 3: ("mit", 1.0), 4: ("mit", 1.0)}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [suffixes.repeated(df).count(), substrings.deduped(df).count(), jaccard.linked(df).count(), linechunks.deduped(df).count(), bpe.bpe(df).count(), licenses.scanned(df).count()] == [0] * 6
    assert decontaminate.decontaminated(df, bench).count() == 0
    assert decontaminate.decontaminated(some, bench).first().n_hit == 0


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_against_sql(name, same):
    same(queries.queries()[name], queries.oracle_sql()[name])


def test_staged_tables_can_be_cleared(spark):
    at = common.staged(spark.range(3), "some")
    assert at.count() == 3
    common.clear(spark)
    assert not at.inputFiles() or not any(__import__("os").path.exists(f.removeprefix("file://")) for f in at.inputFiles())
