"""Operators without an exact SQL statement, and the pipeline."""

import re
import time
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from millrace.llm import html, linechunks, neighbours, quality


def brute(rows, k=10, every=100, size=6):
    own = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    x = np.array([v for _, v in own], float)
    out = set()
    for i, v in own:
        if i % every == 0:
            d = neighbours.distance(np.array(v, float), x)
            best = sorted((s, j) for s, (j, _) in zip(d.tolist(), own, strict=True) if j != i)[:k]
            out |= {(i, r, j, s) for r, (s, j) in enumerate(best, 1)}
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).astype("f4").tolist()) for i in range(700)]
    hot = rows[100][1]
    rows += [(1000 + i, hot) for i in range(350)]
    return rows + [(2000, None), (2100, [0.0] * 6), (2200, [float("nan")] * 6), (2300, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (2400, [float("inf")] * 6), (2500, [1.0, 2.0]), (None, hot), rows[0], (2600, [-0.0, 1.0, 0.0, 0.0, 0.0, 0.0]), (2601, [0.0, 1.0, 0.0, 0.0, 0.0, 0.0])]


def test_neighbours(spark, vectors):
    df = spark.createDataFrame([(i, v, "clash") for i, v in vectors], "vec_id long, embedding array<float>, id string").repartition(3)
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.searched(df).collect()}
    assert got == brute(vectors)


def recall(got, want):
    pairs = {(q, v) for q, _, v, _ in want}
    return len(pairs & {(r.query_id, r.vec_id) for r in got}) / len(pairs)


def test_windows_alone(spark, vectors):
    """Without widening: nine tenths on vectors that cluster with default windows, and on noise with wider ones."""
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    assert recall(neighbours.searched(df, widen=False, curves=8, window=96).collect(), brute(vectors)) >= 0.9
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 24))
    rows = [(i, (centres[i % 40] + 0.05 * rng.normal(size=24)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert recall(neighbours.searched(df, widen=False).collect(), brute(rows, size=24)) >= 0.9


def test_far_from_the_origin(spark):
    """Close groups of long vectors: nothing is lost to rounding."""
    rng = np.random.default_rng(4)
    for middle, spread, kind in ((1e4, 1e-4, "double"), (100, 1e-3, "float"), (0.0, 1e-4, "double")):
        far = 1e7 * rng.normal(size=(3, 12)) if not middle else np.full((3, 12), middle)
        rows = [(i, (far[i % 3] + spread * rng.normal(size=12)).astype("f4" if kind == "float" else "f8").tolist()) for i in range(1500)]
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
        got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.searched(df).collect()}
        assert got == brute(rows, size=12)


def test_vectors_of_each_length(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=6 if i % 3 else 4).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.searched(df).collect()}
    assert got == brute(rows, size=6) | brute(rows, size=4)


def test_few_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.searched(empty).count() == 0
    three = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r.vec_id) for r in neighbours.searched(three).orderBy("rank").collect()] == [(1, 2), (2, 1)]


def test_hilbert():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    order = cells[np.argsort(neighbours.hilbert(cells, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


CASES = {
    "": "",
    "plain &amp; simple": "plain & simple",
    "<p>a<p>b": "a\n\nb",
    "<ul><li>x<ul><li>y</ul><li>z</ul><ol start=3><li>q<li>r</ol>": "- x\n  - y\n- z\n\n3. q\n4. r",
    "<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>": "a    | bbb\ncccc | d",
    "<table><caption>T</caption><thead><tr><th>h</thead><tbody><tr><td><p>x</p><p>y</p></table>": "T\nh\nx y",
    "<p hidden>no<p>yes<div style='color:red; display: none'>no<b>no</b></div>after<script>if (a<b) x()</script>": "yes\n\nafter",
    "<head><title>t</title></head><body>b<!-- no <p>no -->c<br>d": "bc\nd",
    "<pre> a\n  b</pre>": " a\n  b",
    "<dl><dt>t<dd>d<dt>u</dl>": "t\n  d\nu",
    "<div>a <b>b</b>\n\n c</div>d": "a b c\nd",
    "</p></div>x</b>": "x",
    "a < b > c": "a < b > c",
    "<p>unclosed <b": "unclosed <b",
    "<dialog>no</dialog><dialog open>yes</dialog>": "yes",
    "<blockquote>q<p>r</blockquote>": "  q\n\n  r",
    "<textarea><b>x</b></textarea>": "<b>x</b>",
}


#: Quotes that open no value are characters of their tag and swallow no text.
QUOTES = {
    '<p>one <a href="x"">two</a> three <a href="y"">four</a>': "one two three four",
    "<p title=don't>six</p><p>it's > seven</p>": "six\n\nit's > seven",
    "<p title='a > b' id = \"c > d\">x<p a='\"' b>y": "x\n\ny",
    "<p a=b='c>d</p>'": "d\n\n'",
    "<p \"hidden\">shown<p title=x' hidden>no": "shown",
    "<p>a<b title=\"open>b": "ab",
}


#: Options, drawings, formulas, visibility, cells that span.
SEEN = {
    "a <select><option>x<option selected>y<option>z</select> b": "a y b",
    "<select multiple><option>x<option>y</select>": "x\ny",
    "<svg><title>no</title><desc>no</desc><text x=1>one</text><g><text>two</text></g></svg>": "one\ntwo",
    "<math><semantics><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></semantics></math>": "x=1",
    "<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b><p>no</div>z": "yes\n\nz",
    "<div style='display:none'><b style='visibility:visible'>no</b></div>z": "z",
    "<table><tr><th colspan=2>a wide heading<tr><td>x<td>y<tr><td>long<td>z</table>": "a wide heading\nx    | y\nlong | z",
    "<table><tr><td colspan=2>wider than both<td>e<tr><td>x<td>y<td>f</table>": "wider than both | e\nx | y           | f",
    "<table><tr><td rowspan=2>r<td>x<tr><td>y<tr><td>s<td>z</table>": "r | x\n  | y\ns | z",
    "<table><tr><td><table><tr><td>i<td>j</table><td>k</table>": "i | j | k",
    "<a <b>x</b>": "<a x",
    "<p a=x<y b>z": "<p a=xz",
}


@pytest.mark.parametrize("source", list(SEEN))
def test_html_that_is_seen(source):
    assert html.render(source) == SEEN[source]


def written(rng, depth=0):
    """A random page part: its markup, with end tags left out where they may be, and its lines as (blank line around, lines)."""
    word = lambda: "".join(rng.choice(list("abcdefg"), rng.integers(1, 6)))
    kind = rng.choice(["p", "div", "h2", "ul", "ol", "quote", "table", "hidden", "pre"] if depth < 3 else ["p", "div"])
    text = " ".join(word() for _ in range(rng.integers(1, 4)))
    loose = text.replace(" ", "\n  ", 1)
    if kind in ("p", "h2"):
        return f"<{kind}>{loose}<i></i>" + ("" if kind == "p" and rng.random() < 0.5 else f"</{kind}>"), [(1, [text])]
    if kind == "div":
        return f"<div>{loose}</div>", [(0, [text])]
    if kind == "hidden":
        return f"<div hidden>{loose}<p>no</div><script>no()</script><!-- no -->", []
    if kind == "pre":
        return f"<pre>{text}\n  {text}</pre>", [(1, [text, f"  {text}"])]
    if kind == "table":
        cells = [[word() for _ in range(3)] for _ in range(rng.integers(1, 4))]
        wide = [max(len(r[k]) for r in cells) for k in range(3)]
        close = rng.random() < 0.5
        markup = "".join("<tr>" + "".join(f"<td> {c}{'</td>' * close}" for c in r) + "</tr>" * close for r in cells)
        return f"<table>{markup}</table>", [(1, [" | ".join(c.ljust(w) for c, w in zip(r, wide, strict=True)).rstrip() for r in cells])]
    parts = [[written(rng, depth + 1) for _ in range(rng.integers(1, 3))] for _ in range(rng.integers(1, 3))]
    flat = lambda item: [(0 if m.startswith(("<ul", "<ol")) else gap, x) for m, found in item for gap, x in found]  # noqa: E731  lists in boxes stand close
    if kind == "quote":
        lines = stacked(flat(parts[0]))
        return "<blockquote>" + "".join(m for m, _ in parts[0]) + "</blockquote>", [(1, [f"  {x}" if x else "" for x in lines])]
    lines, markup = [], ""
    for n, item in enumerate(parts, 1):
        first = word()
        mark = f"{n}. " if kind == "ol" else "- "
        own = stacked([(0, [first]), *flat(item)])
        lines += [mark + own[0], *(" " * len(mark) + x if x else "" for x in own[1:])]
        markup += f"<li>{first}" + "".join(m for m, _ in item) + ("</li>" if rng.random() < 0.5 else "")
    return f"<{kind}>{markup}</{kind}>", [(1, lines)]


def stacked(parts):
    lines, before = [], 0
    for gap, own in parts:
        if own:
            lines += ([""] if lines and max(gap, before) else []) + own
        before = gap if own else max(gap, before)
    return lines


def test_html_against_a_second_renderer():
    rng = np.random.default_rng(12)
    for _ in range(400):
        made = [written(rng) for _ in range(rng.integers(1, 5))]
        assert html.render("".join(m for m, _ in made)) == "\n".join(stacked([x for _, own in made for x in own]))


@pytest.mark.parametrize("source", ["<div>" * 200_000 + "x", "<a " * 300_000, "<b>" * 80_000 + "</i>" * 80_000, "<ul><li>x" * 60_000, "<table><tr><td>" * 50_000 + "x", "<p><object>" + "<div>" * 150_000, "<a x=\"" * 150_000, "<textarea>" + "</textarea " * 90_000, "<" * 1_000_000, "<a b" + " " * 500_000])
def test_html_in_linear_time(source):
    """A megabyte or so of nested or unclosed markup; a quadratic walk would take minutes."""
    began = time.process_time()
    html.render(source)
    assert time.process_time() - began < 8


def test_layout_is_kept_at_any_depth():
    lines = html.render("<ul><li>x" * 200).split("\n")
    assert len(lines) == 200 and lines[50] == " " * 100 + "- x" and lines[150] == " " * html.INDENT + "- x"
    assert html.render("<ul><li>" * 100 + "x") == "- " * 100 + "x"


@pytest.mark.parametrize("source", list(QUOTES))
def test_quotes_in_tags(source):
    assert html.render(source) == QUOTES[source]


@pytest.mark.parametrize("source", list(CASES))
def test_html(source):
    assert html.render(source) == CASES[source]


def test_html_of_any_depth():
    assert html.render("<div>" * 50_000 + "x") == "x"
    assert html.render("<ul><li>" * 3000 + "x").endswith("x")
    assert html.render("<table><tr><td>" * 3000 + "x").endswith("x")


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "<p>a", "u"), (1, "<p>a", "u"), (2, None, "u"), (None, "b", "u")], "page_id long, html string, text string")
    assert sorted((r.page_id or 0, r.text) for r in html.extracted(df).collect()) == [(0, "b"), (1, "a"), (1, "a"), (2, "")]


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = "pmod(xxhash64(doc_id), 3) = 0"
    found = quality.classified(docs, labels.where(f"not ({held})"))
    assert found.count() == docs.count()
    rows = found.join(labels.where(held), "doc_id").collect()
    good = [r.keep for r in rows if r.quality == 1 and r.toxic == 0]
    junk = [r.keep for r in rows if r.quality == 0]
    assert np.mean(good) >= 0.97 and np.mean(junk) <= 0.2


def posteriors(rows, p):
    """rows: host, path. The whole of the hierarchy again, in numpy: posterior of being good of each row."""
    p = np.array(p)
    overall = min(max(p.mean(), 1e-4), 1 - 1e-4)

    def strength(bad, n, prior):
        bad, n, prior = map(np.array, (bad, n, prior))
        if len(n) < 2:
            return 100.0
        m = min(max(prior.mean(), 1e-4), 1 - 1e-4)
        q = (n * (bad / n - prior) ** 2).sum()
        spread = max((q - (len(n) - 1) * m * (1 - m)) / max(n.sum() - (n * n).sum() / n.sum(), 1e-9), 1e-6)
        return min(max(m * (1 - m) / spread - 1, 1.0), 1e6)

    sums = {}
    for site, x in zip(rows, p.tolist(), strict=True):
        for key in (site, site[:1]):
            b, n = sums.get(key, (0.0, 0))
            sums[key] = b + x, n + 1
    hosts = [k for k in sums if len(k) == 1]
    k = strength([sums[h][0] for h in hosts], [sums[h][1] for h in hosts], [overall] * len(hosts))
    host = {h: (sums[h][0] + k * overall) / (sums[h][1] + k) for h in hosts}
    paths = [x for x in sums if len(x) == 2]
    k = strength([sums[x][0] for x in paths], [sums[x][1] for x in paths], [host[x[:1]] for x in paths])
    path = {x: (sums[x][0] + k * host[x[:1]]) / (sums[x][1] + k) for x in paths}
    clip, odds = (lambda x: min(max(x, 1e-6), 1 - 1e-6)), lambda x: np.log(x / (1 - x))
    return [1 / (1 + np.exp(odds(clip(x)) + odds(clip(path[site])) - odds(overall))) for site, x in zip(rows, p.tolist(), strict=True)]


def test_quality_against_numpy(spark):
    """Every score and decision from the evidence model's own answer for each text, and the hierarchy computed again."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.trained(docs, labels)
    rows = docs.select("doc_id", "text", "lang", "source").collect()
    want = dict(zip([r.doc_id for r in rows], posteriors([(r.source or "", r.lang or "") for r in rows], [model.bad((r.text or "").encode()) for r in rows]), strict=True))
    got = quality.classified(docs, labels).collect()
    assert len(got) == len(want)
    for r in got:
        assert abs(r.score - want[r.doc_id]) < 1e-6 and r.keep == (r.score >= quality.KEEP)


def test_toxic_documents_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = "pmod(xxhash64(doc_id), 3) = 1"
    rows = quality.classified(docs, labels.where(f"not ({held})")).join(labels.where(held), "doc_id").collect()
    assert np.mean([r.keep for r in rows if r.toxic == 1]) <= 0.08
    assert np.mean([r.keep for r in rows if r.quality == 1 and r.toxic == 0]) >= 0.995


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "a b", None, "s"), (2, None, "en", None), (None, "", "x", "y"), (1, "a b", "en", "s")], "doc_id long, text string, lang string, source string")
    assert quality.classified(docs, labels).count() == 4
    assert quality.classified(docs, labels.where("false")).where("keep").count() == 4
    assert quality.classified(docs.where("false"), labels).count() == 0


def test_shrinkage(spark):
    """A sparse site's rate lies between its own share and its host's."""
    rows = [("h", "a", 1.0)] * 2 + [("h", "b", 0.1)] * 200 + [("g", "a", 0.3)] * 300
    sites, overall = quality.rates(spark.createDataFrame(rows, "host string, path string, p double"))
    got = {(r.h, r.pa): r for r in sites.collect()}
    assert got["h", "a"].host_rate < got["h", "a"].path_rate < 1.0
    assert abs(overall - sum(p for *_, p in rows) / len(rows)) < 1e-9


def test_pipeline(spark, sf_dir, monkeypatch):
    """run() hands each stage's table to the next one; all but the last keep the columns of documents and drop rows only."""
    seen = []

    def noted(name, stage):
        def call(spark, docs, sf_dir):
            seen.append((name, docs.columns, docs.count()))
            return stage(spark, docs, sf_dir)

        return name, call

    monkeypatch.setattr(corpus_pipeline, "STAGES", [noted(*s) for s in corpus_pipeline.STAGES])
    n = corpus_pipeline.run(spark, sf_dir).count()
    assert [c for _, c, _ in seen] == [["doc_id", "text", "lang", "source", "n_chars"]] * 5
    counts = [k for *_, k in seen] + [n]
    assert counts == sorted(counts, reverse=True) and n > 0.5 * counts[0]


def fold(text):
    return [(m.start(), m.end(), m[0].lower()) for m in re.finditer(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())]


def test_pipeline_against_brute_force(spark, sf_dir):
    """run() against each stage by plain loops, one after the other, down to the ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs.select("doc_id", "text", "lang", "source").collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    # 9: evidence of the fitted model, the hierarchy by numpy
    model = quality.trained(docs, labels)
    score = posteriors([(r.source or "", r.lang or "") for r in rows], [model.bad((r.text or "").encode()) for r in rows])
    texts = {r.doc_id: (r.text or "").encode() for r, x in zip(rows, score, strict=True) if x >= quality.KEEP}
    assert len(texts) < len(rows)
    # 7: all but the first of equal chunks
    seen, after = set(), {}
    for d in sorted(texts):
        lines, spans = linechunks.spans_of(texts[d], linechunks.PERIOD, True)
        gone = set()
        for a, b in spans:
            whole = b"\n".join(lines[a:b])
            if b - a > 1 and whole.strip():
                if whole in seen:
                    gone |= set(range(a, b))
                seen.add(whole)
        left = b"\n".join(x for i, x in enumerate(lines) if i not in gone)
        if not gone or left.strip():
            after[d] = left
    assert sum(map(len, after.values())) < sum(map(len, texts.values()))
    # 3: the smallest of each component at 0.8 of five words
    sets = {}
    for d, t in after.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", t.lower())
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    kept = {d: t for d, t in after.items() if find(d) == d}
    assert len(kept) < len(after)
    # 2: words within any occurrence of ten words of an item
    phrases = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = [x for *_, x in fold((r.text or "").encode())]
        phrases |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    clean, n_hit = {}, 0
    for d, t in kept.items():
        w = fold(t)
        hit = np.zeros(len(w) + 1, bool)
        for n in {len(p) for p in phrases}:
            for i in range(len(w) - n + 1):
                if tuple(x for *_, x in w[i : i + n]) in phrases:
                    hit[i : i + n] = True
        parts, at = [], 0
        for i in range(len(w)):
            if hit[i] and not (i and hit[i - 1]):
                parts.append(t[at : w[i][0]])
            if hit[i] and not hit[i + 1]:
                at = w[i][1]
        left = b" ".join([*parts, t[at:]])
        n_hit += int(hit.sum())
        if not hit.any() or left.strip():
            clean[d] = left
    assert n_hit > 0
    # 5
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {d: lib.encode(t.decode(), add_special_tokens=False).ids for d, t in clean.items()}
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got.keys() == want.keys()
    assert got == want


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_pipeline_on_empty_tables(spark, sf_dir, tmp_path, empty):
    for name in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        df.where("false" if name == empty else "true").write.parquet(f"{tmp_path}/{name}.parquet")
    n = corpus_pipeline.run(spark, str(tmp_path)).count()
    assert (n == 0) == (empty == "documents")


def test_stages_on_odd_rows(spark, sf_dir):
    rows = [(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (2, "a b c d e f g", "en", "s", 13), (None, None, None, None, None), (3, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.one_of_each(spark, docs, sf_dir).collect()) == [0, 1, 3]
    assert corpus_pipeline.distinct_lines(spark, docs, sf_dir).count() == 5
    assert corpus_pipeline.clean_of_benchmarks(spark, docs, sf_dir).count() == 5
    assert corpus_pipeline.good_documents(spark, docs, sf_dir).columns == docs.columns


def test_stages_take_any_columns_along(spark, sf_dir):
    docs = spark.range(3).selectExpr("id as doc_id", "'one two three' as text", "timestamp'2000-01-01' as at", "array(id) as list", "map('k', id) as m", "cast(id as decimal(9,2)) as `odd name`", "cast(null as string) as lang", "'s' as source", "'x' as tag", "1 as n_hit")
    for stage in (corpus_pipeline.distinct_lines, corpus_pipeline.clean_of_benchmarks, corpus_pipeline.good_documents):
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        assert {r["odd name"] for r in out.collect()} == {r["odd name"] for r in docs.collect()}
