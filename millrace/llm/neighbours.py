"""Op 8: nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions (principal axes of a bounded sample, turned and shifted anew for each
curve) and ordered by their Hilbert keys, range-partitioned in Spark. The windows of neighbouring keys around each
query, from all curves, merge and are reranked by exact distance, which gives a radius. A window is then widened to
every block of the first curve whose bounding box in the projection may hold a vector within the radius; for data
that cluster these are few blocks, for pure noise they are many. Bounds allow for the rounding of their arithmetic, in
proportion to the vectors' distance from the centre, so the widened search misses nothing.

Equal vectors are one class that keeps its smallest ids (as many as an answer can show), so a vector that a third
of all rows share is one point. Queries go against all rows in blocks of QUERIES; each block is one broadcast.

Vectors that are null, zero, or hold null or non-finite components take no part; null ids neither. Vectors of
different length have no distance: each length is searched on its own. Ties go to the smaller vec_id. With fewer candidates than k, all are
returned. Rows that repeat a vec_id count once if equal; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

K, EVERY = 10, 100
CURVES, WINDOW, AXES, BITS = 4, 64, 8, 7
#: Rows that the projection is fitted on, at most (about).
SAMPLE = 10_000
#: Query classes in one broadcast; rows of a block.
QUERIES, BLOCK = 20_000, 128


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of cell numbers below 2^bits (Skilling's transform, on whole columns)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Curves:
    """A projection with orthonormal axes, and for each curve a turn and a shift of it."""

    def __init__(self, sample: np.ndarray, curves: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.center = sample.mean(axis=0)
        axes = min(AXES, sample.shape[1])
        own = sample - self.center
        self.axes = np.linalg.eigh(own.T @ own)[1][:, ::-1][:, :axes]  # the principal ones, orthonormal for any sample
        own = self.project(sample)
        self.turns, self.low, self.width = [], [], []
        for c in range(curves):
            turn = np.eye(axes) if c == 0 else np.linalg.qr(rng.normal(size=(axes, axes)))[0]
            y = own @ turn
            low, span = y.min(axis=0), np.ptp(y, axis=0) + 1e-9
            self.turns.append(turn)
            self.low.append(low - span * (0.05 + 0.3 * rng.random(axes)))
            self.width.append(1.4 * span)

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.center) @ self.axes

    def keys(self, x: np.ndarray, curve: int) -> np.ndarray:
        cells = (self.project(x) @ self.turns[curve] - self.low[curve]) / self.width[curve] * (1 << BITS)
        return hilbert(np.clip(cells, 0, (1 << BITS) - 1).astype(np.int64), BITS)


def distance(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of x to rows of q (or to one), summed in the order of the components."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += (x[:, d] - q[..., d]) ** 2
    return np.sqrt(total)


def as_rows(batch: pa.RecordBatch, name: str = "vector") -> np.ndarray:
    values = b"".join(batch.column(name).to_pylist())
    return np.frombuffer(values, "<f8").reshape(batch.num_rows, -1)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (list of doubles) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        "vec_id is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)"
    )


def classes(rows: DataFrame, k: int, every: int) -> DataFrame:
    """key, vector (binary doubles), ids (the k + 1 smallest), asked (whether a query is among all ids); copies of a batch meet before the shuffle."""
    schema = "key long, vector binary, ids array<long>, asked boolean"

    def gather(found: dict, vector: bytes, ids: list[int], asked: bool) -> None:
        old = found.get(vector)
        found[vector] = (sorted({*ids, *old[0]})[: k + 1], asked or old[1]) if old else (ids, asked)

    def record(found: dict) -> dict:
        return {"key": [xxhash.xxh3_64_intdigest(v) - (1 << 63) for v in found], "vector": list(found), "ids": [x[0] for x in found.values()], "asked": [x[1] for x in found.values()]}

    def first(batch: pa.RecordBatch) -> Iterator[dict]:
        values = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(batch.num_rows, -1) + 0.0  # -0.0 is 0.0
        found: dict[bytes, tuple[list[int], bool]] = {}
        for i, x in zip(batch.column("vec_id").to_pylist(), values, strict=True):
            gather(found, x.tobytes(), [i], i % every == 0)
        yield record(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in C.groups(batches, "key"):
            found: dict[bytes, tuple[list[int], bool]] = {}
            for row in group.to_batches():
                for v, ids, asked in zip(*(row.column(c).to_pylist() for c in ("vector", "ids", "asked")), strict=True):
                    gather(found, v, ids, asked)
            yield C.record(record(found), arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    n = C.partitions(rows.sparkSession)
    return C.mapped(rows, first, schema).repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, schema)


class Best:
    """The nearest ids of each query so far."""

    def __init__(self, k: int):
        self.k, self.found = k, {}

    def add(self, query: int, scores: np.ndarray, ids: list[list[int]]) -> None:
        own = self.found.get(query, [])
        own = sorted({*own, *((s, i) for s, some in zip(scores.tolist(), ids, strict=True) for i in some)})[: self.k + 1]
        self.found[query] = own

    def rows(self) -> dict:
        return {"query": list(self.found), "best": [[{"score": s, "vec_id": i} for s, i in x] for x in self.found.values()]}


BEST = "query long, best array<struct<score: double, vec_id: long>>"


def windowed(points: DataFrame, curve: int, curves, k: int, window: int) -> DataFrame:
    """Best of the window of neighbouring keys around each query on one curve. Reads a range in key order and holds two windows of it."""

    def keyed(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {"at": curves.value.keys(as_rows(batch), curve)} | {c: batch.column(c) for c in ("id", "vector", "ids", "asked")}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, 0  # rows kept, and how many of them have been searched
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                own = pa.Table.from_batches([batch.slice(a, 2048)])
                held = own if held is None else pa.concat_tables([held, own])
                if (to := held.num_rows - window) > done:
                    yield around(held, done, to)
                    drop = max(0, to - window)
                    held, done = held.slice(drop), to - drop
        if held is not None and held.num_rows > done:
            yield around(held, done, held.num_rows)

    def around(held: pa.Table, a: int, b: int) -> pa.RecordBatch:
        batch = held.combine_chunks().to_batches()[0]
        x, ids, asked, name = as_rows(batch), batch.column("ids").to_pylist(), batch.column("asked").to_pylist(), batch.column("id").to_pylist()
        best = Best(k)
        for i in range(a, b):
            if asked[i]:
                lo, hi = max(0, i - window), i + window + 1
                scores = distance(x[i], x[lo:hi])
                near = np.argsort(scores, kind="stable")[: k + 1]
                near = np.flatnonzero(scores <= scores[near[-1]])
                best.add(name[i], scores[near], [ids[lo + j] for j in near])
        return C.record(best.rows(), arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(BEST))
    n = C.partitions(points.sparkSession)
    ordered = C.mapped(points, keyed, "at long, id long, vector binary, ids array<long>, asked boolean").repartitionByRange(n, "at", "id").sortWithinPartitions("at", "id")
    return ordered.mapInArrow(search, BEST)


def merged(found: DataFrame, k: int) -> DataFrame:
    """The k + 1 best of each query from rows that hold so many each."""
    flat = F.array_distinct(F.flatten(F.collect_list("best")))
    return found.groupBy("query").agg(F.slice(F.array_sort(flat), 1, k + 1).alias("best"))


def widened(points: DataFrame, queries, curves, k: int) -> DataFrame:
    """Best of the blocks of the first curve that may hold a vector within a query's radius."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, q, radius, own = queries.value
        best, middle = Best(k), curves.value.center
        centred = q - middle  # around the centre: products of large equal parts would cancel
        square = (centred * centred).sum(axis=1)
        length, unit = np.sqrt(square), 8 * (q.shape[1] + 8) * np.finfo(float).eps
        for batch in batches:
            x, ids = as_rows(batch), batch.column("ids").to_pylist()
            y = curves.value.project(x)
            for a in range(0, len(x), BLOCK):
                some, box = x[a : a + BLOCK], y[a : a + BLOCK]
                moved = some - middle
                squares = (moved * moved).sum(axis=1)
                scale = length + np.sqrt(squares.max())
                gap = np.maximum(np.maximum(box.min(axis=0) - own, own - box.max(axis=0)), 0)
                near = np.flatnonzero(np.sqrt((gap * gap).sum(axis=1)) <= radius * (1 + 1e-9) + unit * scale)
                if not len(near):
                    continue
                rough = square[near, None] + squares - 2 * (centred[near] @ moved.T)
                i, j = np.nonzero(rough <= (radius[near, None] * (1 + 1e-9)) ** 2 + unit * scale[near, None] ** 2)
                scores = distance(q[near[i]], some[j])
                for query in np.unique(i):
                    at = np.flatnonzero(i == query)
                    best.add(name[near[query]], scores[at], [ids[a + t] for t in j[at]])
        yield C.record(best.rows(), arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(BEST))
    return points.mapInArrow(search, BEST)


def searched(vectors: DataFrame, k: int = K, every: int = EVERY, curves: int = CURVES, window: int = WINDOW, widen: bool = True) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose vec_id is divisible by `every`."""
    rows = usable(vectors)
    sizes = sorted(r.n for r in rows.where(F.col("vec_id") % every == 0).select(F.size("v").alias("n")).distinct().collect())
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = [of_one_length(rows.where(F.size("v") == n), k, every, curves, window, widen) for n in sizes]
    return reduce(DataFrame.union, found)


def of_one_length(rows: DataFrame, k: int, every: int, curves: int, window: int, widen: bool) -> DataFrame:
    spark = rows.sparkSession
    points = C.staged(classes(rows, k, every).withColumn("id", F.element_at("ids", 1)).drop("key"), "classes")
    total = points.count()
    part = points.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) <= int(1_000_000 * SAMPLE / max(total, SAMPLE))).select("vector").toArrow()
    sample = np.frombuffer(b"".join(part["vector"].to_pylist()), "<f8").reshape(part.num_rows, -1)
    shared = spark.sparkContext.broadcast(Curves(sample, curves))
    found = windowed(points, 0, shared, k, window)
    for c in range(1, curves):
        found = found.union(windowed(points, c, shared, k, window))
    found = C.staged(merged(found, k), "windows")
    if widen:
        asked = C.staged(points.where("asked").join(found, F.col("id") == F.col("query")).select("id", "vector", F.when(F.size("best") > k, F.element_at("best", -1)["score"]).otherwise(F.lit(float("inf"))).alias("radius")), "asked")
        blocks = max(1, -(-asked.count() // QUERIES))
        first = points.sparkSession

        def keyed(batch: pa.RecordBatch) -> Iterator[dict]:
            yield {"at": shared.value.keys(as_rows(batch), 0)} | {c: batch.column(c) for c in ("id", "vector", "ids")}

        ordered = C.staged(C.mapped(points, keyed, "at long, id long, vector binary, ids array<long>").repartitionByRange(C.partitions(first), "at", "id").sortWithinPartitions("at", "id"), "curve")
        for b in range(blocks):
            own = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
            q = np.frombuffer(b"".join(own["vector"].to_pylist()), "<f8").reshape(own.num_rows, sample.shape[1])
            queries = spark.sparkContext.broadcast((own["id"].to_pylist(), q, own["radius"].to_numpy(), shared.value.project(q)))
            found = found.union(widened(ordered, queries, shared, k))
        found = merged(found, k)
    named = rows.where(F.col("vec_id") % every == 0).select("vec_id", "v").distinct()
    named = C.mapped(named, lambda batch: iter([{"query_id": batch.column("vec_id"), "own": [(np.array(v, "<f8") + 0.0).tobytes() for v in batch.column("v").to_pylist()]}]), "query_id long, own binary")
    named = named.join(points.where("asked").select(F.col("vector").alias("own"), "id"), "own").select("query_id", "id")
    answer = named.join(found, F.col("id") == F.col("query")).select("query_id", F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k).alias("best"))
    return answer.select("query_id", F.posexplode("best").alias("p", "b")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searched(C.table(spark, sf_dir, "embeddings"))


#: Every query against every row; squares are summed in the order of the components.
OP8_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT * FROM v WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])), lambda a, x: a + x)) AS score FROM u q JOIN u c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
