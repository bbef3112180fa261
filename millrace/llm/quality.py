"""Op 9: quality classifier by hierarchical empirical Bayes.

Evidence: two logistic models (junk, toxic) over the style of a text and over words and word beginnings that tell
classes apart, fitted on at most SAMPLE labelled rows. Prior: the share of bad documents of the document's path
within its host, shrunk to the host's share, itself shrunk to the global one; how strongly is estimated from how
much hosts and paths differ beyond chance. The posterior odds are the evidence's odds times path odds over global
odds. A document is kept if its posterior of being good is at least KEEP.

Here a host is a document's `source` and a path its `lang` within it; nulls are a host or path of their own. Null
and empty texts have no words and are judged by style and site. Rows that repeat a doc_id are each scored. Without
labels of both classes the evidence is the global prior and every document is kept. Other columns aren't read.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Labelled rows that a model is fitted on, at most (about).
SAMPLE = 20_000
#: Words and beginnings chosen for each model.
FEATURES = 512
#: On labels held out from the fit (sf0.1, three folds) 0.6 keeps 0.5 % of junk and 2.7 % of toxic documents and rejects none of 3027 clean ones.
KEEP = 0.6
#: Sites whose rates are broadcast; beyond, they are joined by a shuffle.
SITES = 200_000
_UPPER, _LOWER, _DIGIT = (bytes(range(*r)) for r in ((65, 91), (97, 123), (48, 58)))
_HEADS = ("junk", "toxic")


def style(text: bytes, words: list[bytes]) -> list[float]:
    n, k = max(1, len(text)), max(1, len(words))
    upper = len(text) - len(text.translate(None, _UPPER))
    small = len(text) - len(text.translate(None, _LOWER))
    digit = len(text) - len(text.translate(None, _DIGIT))
    marks = [text.count(c) for c in (b"!", b"|", b"*", b"#", b"$", b"%", b"&", b"\n")]
    same = sum(map(operator.eq, words, words[1:]))
    shares = [upper / n, small / n, digit / n, *[m / k for m in marks], same / k, len(set(words)) / k]
    return [*shares, *np.log1p([upper, digit, *marks, same, len(words)]).tolist()]


def beginnings(word: bytes) -> Iterator[int]:
    """The word and its beginnings, as 64-bit integers."""
    yield xxhash.xxh3_64_intdigest(b"=" + word) - (1 << 63)
    for n in (4, 6, 8):
        if len(word) > n:
            yield xxhash.xxh3_64_intdigest(b"%d" % n + word[:n]) - (1 << 63)


class Finder(dict):
    """Which chosen features a word has, for the words seen last."""

    MOST = 300_000

    def __init__(self, chosen: dict[int, int]):
        super().__init__()
        self.chosen = chosen

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = got = tuple(self.chosen[f] for f in beginnings(word) if f in self.chosen)
        return got

    def __reduce__(self):
        return Finder, (self.chosen,)

    def of(self, words: set[bytes]) -> list[int]:
        return sorted({i for got in map(self.__getitem__, words) if got for i in got})


def feature_counts(sample: DataFrame) -> DataFrame:
    """feature, documents with it, and how many of these are junk and toxic."""

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        known: dict[bytes, list[int]] = {}
        counts: dict[int, list[int]] = {}
        for text, *bad in zip(C.as_bytes(batch.column("text")), *(batch.column(h).to_pylist() for h in _HEADS), strict=True):
            own = {f for w in set(C.fold(text).split()) for f in (known.get(w) or known.setdefault(w, [*beginnings(w)]))}
            for f in own:
                c = counts.setdefault(f, [0, 0, 0])
                c[0] += 1
                c[1] += bad[0]
                c[2] += bad[1]
        if counts:
            yield {"feature": list(counts)} | {n: [c[i] for c in counts.values()] for i, n in enumerate(("n", *_HEADS))}

    return C.mapped(sample, step, "feature long, n long, junk long, toxic long", 8 * C.STEP).groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n", *_HEADS)]).where("n >= 4")


def choose(counts: DataFrame, head: str, total: int, bad: int) -> list[int]:
    """The features with the largest likelihood ratio against chance, most telling first."""
    a, n = F.col(head).cast("double"), F.col("n").cast("double")
    term = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    ratio = 2 * (term(a, n * bad / total) + term(n - a, n * (total - bad) / total) + term(bad - a, (total - n) * bad / total) + term((total - bad) - (n - a), (total - n) * (total - bad) / total))
    rows = counts.select("feature", ratio.alias("g")).where("g > 15").orderBy(F.desc("g"), "feature").limit(FEATURES).collect()
    return [r.feature for r in rows]


def fitted(dense: np.ndarray, present: np.ndarray, y: np.ndarray, ridge: float = 2.0, block: int = 1000) -> np.ndarray:
    """Logistic regression by Newton steps, summed over blocks of rows; the intercept, first, is not shrunk."""
    w = np.zeros(1 + dense.shape[1] + present.shape[1])
    shrink = np.full(len(w), ridge)
    shrink[0] = 1e-6
    for _ in range(25):
        gradient, curve = -shrink * w, np.diag(shrink)
        for a in range(0, len(y), block):
            x = np.concatenate([np.ones((len(y[a : a + block]), 1)), dense[a : a + block], present[a : a + block]], axis=1)
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient += x.T @ (y[a : a + block] - p)
            curve += (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x
        move = np.linalg.solve(curve, gradient)
        w += move
        if np.abs(move).max() < 1e-4:
            break
    return w


class Model:
    def __init__(self, chosen: list[list[int]], center: np.ndarray, scale: np.ndarray, weights: list[np.ndarray]):
        self.ids = {f: i for i, f in enumerate(dict.fromkeys(f for c in chosen for f in c))}
        self.finder = Finder(self.ids)
        self.center, self.scale, n = center, scale, len(center)
        self.dense = [w[: n + 1] for w in weights]
        self.word = np.zeros((len(weights), len(self.ids)))
        for k, (c, w) in enumerate(zip(chosen, weights, strict=True)):
            self.word[k, [self.ids[f] for f in c]] = w[n + 1 :]

    def bad(self, text: bytes) -> float:
        """Probability of being junk or toxic."""
        words = C.fold(text).split()
        z = np.clip((np.array(style(text, words)) - self.center) / self.scale, -6, 6)
        own = self.finder.of(set(words))
        good = 1.0
        for dense, word in zip(self.dense, self.word, strict=True):
            good /= 1 + np.exp(min(30.0, dense[0] + float(dense[1:] @ z) + float(word[own].sum())))
        return 1 - good


def trained(docs: DataFrame, labels: DataFrame) -> Model | None:
    """docs: doc_id, text; labels: doc_id, quality, toxic. The sample is dealt by a hash of doc_id."""
    labels = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg((1 - F.coalesce(F.min("quality"), F.lit(1))).cast("long").alias("junk"), F.coalesce(F.max("toxic"), F.lit(0)).cast("long").alias("toxic"))
    n = labels.count()
    if n > SAMPLE:
        labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * SAMPLE / n))
    sample = C.staged(C.keyed(docs).drop("tag").join(F.broadcast(labels), "doc_id").select("doc_id", "text", *_HEADS), "labelled")
    total, *bad = sample.agg(F.count("*"), *[F.coalesce(F.sum(h), F.lit(0)) for h in _HEADS]).first()
    if not total or not any(0 < b < total for b in bad):
        return None
    counts = C.staged(feature_counts(sample), "features")
    chosen = [choose(counts, h, total, b) if 0 < b < total else [] for h, b in zip(_HEADS, bad, strict=True)]
    ids = {f: i for i, f in enumerate(dict.fromkeys(f for c in chosen for f in c))}
    finder = Finder(ids)

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        words = [(t, C.fold(t).split()) for t in C.as_bytes(batch.column("text"))]
        yield {"style": [style(t, w) for t, w in words], "own": [finder.of(set(w)) for _, w in words]} | {h: batch.column(h) for h in _HEADS}

    rows = C.mapped(sample, step, "style array<double>, own array<int>, junk long, toxic long").toArrow()
    dense = rows["style"].combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
    center, scale = dense.mean(axis=0), dense.std(axis=0) + 1e-9
    dense = np.clip((dense - center) / scale, -6, 6)
    own = rows["own"].combine_chunks()
    present = np.zeros((len(dense), len(ids)), bool)
    present[np.repeat(np.arange(len(dense)), own.value_lengths().to_numpy()), own.flatten().to_numpy()] = True
    weights = []
    for h, c in zip(_HEADS, chosen, strict=True):
        y = rows[h].to_numpy().astype(float)
        weights.append(fitted(dense, present[:, [ids[f] for f in c]], y) if 0 < y.sum() < len(y) else np.r_[-30.0, np.zeros(dense.shape[1] + len(c))])
    return Model(chosen, center, scale, weights)


def evidence(frame: DataFrame, model: Model | None) -> DataFrame:
    """frame (doc_id, text, host, path, and carry if given) with p, the evidence of being bad, in place of text."""
    shared = frame.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        p = [shared.value.bad(t) if shared.value else 0.0 for t in C.as_bytes(batch.column("text"))]
        yield {n: batch.column(n) for n in ("doc_id", "host", "path")} | {"p": p} | C.taken(batch)

    return C.mapped(frame, step, C.carried("doc_id long, host string, path string, p double", frame))


def strength(sites: DataFrame, prior: str) -> float:
    """How many documents a site's prior counts for: moments of the sites' rates around it, less what chance makes."""
    r = sites.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count("*").alias("k"), F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col(prior), 2)).alias("q"), F.avg(F.col(prior)).alias("m")).first()
    if not r.n or r.k < 2:
        return 100.0
    m = min(max(r.m, 1e-4), 1 - 1e-4)
    spread = max((r.q - (r.k - 1) * m * (1 - m)) / max(r.n - r.nn / r.n, 1e-9), 1e-6)
    return float(min(max(m * (1 - m) / spread - 1, 1.0), 1e6))


def rates(scored: DataFrame) -> tuple[DataFrame, float]:
    """Shrunk share of bad documents of each host and path, and the global one. Hot hosts are summed before the shuffle."""
    paths = C.staged(scored.groupBy("host", "path").agg(F.sum("p").alias("bad"), F.count("*").cast("double").alias("n")), "paths")
    total = paths.agg(F.sum("bad"), F.sum("n")).first()
    overall = min(max((total[0] or 0.0) / (total[1] or 1.0), 1e-4), 1 - 1e-4)
    hosts = paths.groupBy("host").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).withColumn("prior", F.lit(overall))
    k = strength(hosts, "prior")
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("bad") + k * overall) / (F.col("n") + k)).alias("host_rate"))
    paths = paths.join(hosts, paths.host.eqNullSafe(hosts.h)).drop("h")
    k = strength(paths, "host_rate")
    return paths.select(F.col("host").alias("h"), F.col("path").alias("pa"), "host_rate", ((F.col("bad") + k * F.col("host_rate")) / (F.col("n") + k)).alias("path_rate")), overall


def classified(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """doc_id, evidence, host_rate, path_rate, score (posterior of being good), keep; carry: columns of docs to take along."""
    model = trained(docs, labels)
    site = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((host, "host"), (path, "path"))]
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, *site, *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carry")] if carry else []))
    scored = C.staged(evidence(frame, model), "evidence")  # each text is read and scored once
    sites, overall = rates(scored)
    sites = C.staged(sites, "sites")
    if sites.count() <= SITES:
        sites = F.broadcast(sites)
    odds = lambda p: F.log(p / (1 - p))
    p, rate = (F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(c))) for c in ("p", "path_rate"))
    score = 1 / (1 + F.exp(odds(p) + odds(rate) - float(np.log(overall / (1 - overall)))))
    joined = scored.join(sites, (scored.host == sites.h) & (scored.path == sites.pa), "left").withColumn("score", score)
    return joined.select("doc_id", F.col("p").alias("evidence"), "host_rate", "path_rate", "score", (F.col("score") >= KEEP).alias("keep"), *(["carry"] if carry else []))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
