"""Op 3: n-gram Jaccard join as a blocked sparse matrix product, and its components.

Documents by distinct n-grams is a sparse matrix A; A A^T holds the overlaps. Size bounds keep most of it from
being computed: a pair at the threshold shares a column among the first n - ceil(t n) + 1 of each row in any
fixed column order, so only those entries are multiplied, in blocks of columns; an entry whose row sizes or
places bound the overlap below the threshold is discarded. Columns seen often in a batch are ordered last, so
that a passage many documents share hardly ever stands among the first.

Rows with equal sets are one class, linked without a product. Within a column's block the product first takes
each document with the smallest one; pairs that pass the exact count join components. Then it takes, of the
columns with three documents or more, the pairs that still lie in different components, so that no link between
different texts is lost and no group of copies is expanded into its pairs.

Words are split at ASCII white space after lower-casing A-Z. Fewer words than n give one n-gram, the whole
sequence; null and empty texts have none and link with nothing. Rows that repeat a doc_id are one node; a row
with a null doc_id links with nothing and has a null component. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import buckets as B
from . import common as C
from .graph import components

NGRAM, PERCENT = 4, 85
#: Frequent columns that are ordered last; any order gives the same links.
FREQUENT = 1 << 18
_ENTRIES = ("<u4", "<i8", "<u4", "<u4")
#: Bits of a set's signature at least.
SIGNATURE = 1 << 10


def ngrams(text: bytes, n: int, cache: C.WordHashes) -> np.ndarray:
    values = C.hashes(C.lower(text), cache)
    if len(values) >= n:
        return C.Rolling(values).every(n)
    return C.Rolling(values).spans(np.array([0]), np.array([len(values)])) ^ C.U64(len(values)) if len(values) else np.empty(0, C.U64)


def frequent(docs: DataFrame, n: int) -> np.ndarray:
    """At most FREQUENT n-grams that two documents of one batch hold, the rarest first."""
    cache = C.WordHashes()

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        own = [np.unique(ngrams(t, n, cache)) for t in C.as_bytes(batch.column("text"))]
        grams, counts = np.unique(np.concatenate(own), return_counts=True)
        often = counts > 1
        yield {"gram": grams[often].view(np.int64), "n": counts[often]}

    rows = C.staged(C.mapped(docs, step, "gram long, n long", 8 * C.STEP).groupBy("gram").agg(F.sum("n").alias("n")), "frequent")
    level = F.floor(F.log2("n") * 8)  # at most some hundred levels
    most, total = 0, 0
    for r in rows.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():
        if (total := total + r.n) > FREQUENT:
            most = r.level + 1
            break
    top = rows.where(level >= most).select("gram", "n").toArrow()
    gram, count = top["gram"].to_numpy(), top["n"].to_numpy()
    return gram[np.lexsort((gram, count))].view(np.uint64)


class Columns:
    """Column number of each n-gram: frequent ones last, the rest in the order of their hash."""

    def __init__(self, often: np.ndarray):
        order = np.argsort(often)
        self.grams, self.place = often[order], order.astype(C.U64)

    def of(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.grams):
            return np.unique(grams >> C.U64(1))
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        return np.unique(np.where(self.grams[at] == grams, C.U64(1 << 63) | self.place[at], grams >> C.U64(1)))


def first_columns(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def signature(columns: np.ndarray) -> np.ndarray:
    """For each of some cells, a power of two not below the set's size, whether an odd number of the columns falls there."""
    n = max(SIGNATURE, 1 << max(0, len(columns) - 1).bit_length())
    cells = np.bincount((C.mix(columns) >> C.U64(16)).astype(np.int64) & (n - 1), minlength=n) & 1
    return np.packbits(cells.astype(bool)).view(np.int64)


def rows_of(docs: DataFrame, columns, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, two hashes of the set, its first columns, its signature."""
    cache = C.WordHashes()

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        sizes, one, two, firsts, signs = [], [], [], [], []
        for text in C.as_bytes(batch.column("text")):
            own = columns.value.of(ngrams(text, n, cache))
            sizes.append(len(own))
            one.append(C.mix(own).sum(dtype=C.U64))
            two.append(C.mix(own * C.U64(0x9E3779B97F4A7C15) + C.U64(1)).sum(dtype=C.U64))
            firsts.append(own[: first_columns(len(own), percent)].view(np.int64) if len(own) else own.view(np.int64))
            signs.append(signature(own))
        yield {"doc_id": batch.column("doc_id"), "n_shingles": sizes, "one": np.array(one, C.U64).view(np.int64), "two": np.array(two, C.U64).view(np.int64), "firsts": firsts, "sign": signs}

    return C.mapped(docs, step, "doc_id long, n_shingles long, one long, two long, firsts array<long>, sign array<long>")


def entries(classes: DataFrame) -> DataFrame:
    """Entries of the first columns, packed by block of columns."""
    n = C.U64(B.count(classes))

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        for k in range(0, batch.num_rows, 2000):
            some = batch.slice(k, 2000)
            firsts = some.column("firsts")
            counts = np.diff(firsts.offsets.to_numpy())
            column = firsts.flatten().to_numpy().view(np.uint64)
            place = C.ranges(np.zeros(len(counts), np.int64), counts)
            doc = np.repeat(some.column("doc_id").to_numpy(), counts)
            size = np.repeat(some.column("n_shingles").to_numpy(), counts)
            mixed = C.mix(column)
            yield B.packed((mixed % n).astype(np.int64), [mixed >> C.U64(32), doc, size, place], _ENTRIES)

    return C.mapped(classes, step, B.SCHEMA)


def bounded(size_a, place_a, size_b, place_b, percent: int):
    """Whether sizes and places allow the threshold: 100 * overlap >= percent * (a + b - overlap)."""
    overlap = 1 + np.minimum(size_a - place_a - 1, size_b - place_b - 1)
    return (100 + percent) * np.minimum(overlap, np.minimum(size_a, size_b)) >= percent * (size_a + size_b)


def product(packs: DataFrame, percent: int) -> DataFrame:
    """Of each block of columns: kind 0, pairs (a, b) of a document and the smallest one in a column; kind 1, entries of columns with three or more."""
    schema = "kind int, a long, b long, size long, place long"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in C.groups(batches, "bucket"):
            column, doc, size, place = B.unpacked(rows.column("payload").to_pylist(), _ENTRIES)
            order = np.lexsort((doc, column))
            column, doc, size, place = (x[order] for x in (column, doc, size.astype(np.int64), place.astype(np.int64)))
            cuts = B.starts_of(column)
            counts = np.diff(np.r_[cuts, len(column)])
            head, of = np.repeat(cuts, counts), np.repeat(counts, counts)
            rest = np.arange(len(column)) != head
            near = rest & bounded(size[head], place[head], size, place, percent)
            if near.any():
                pair = np.unique(np.stack([doc[head[near]], doc[near]], axis=1), axis=0)
                zero = np.zeros(len(pair), np.int64)
                yield C.record({"kind": zero, "a": pair[:, 0], "b": pair[:, 1], "size": zero, "place": zero}, arrow)
            if (many := of > 2).any():
                yield C.record({"kind": np.ones(many.sum(), np.int64), "a": (int(bucket) << 32) | column[many].astype(np.int64), "b": doc[many], "size": size[many], "place": place[many]}, arrow)

    return packs.repartition(C.partitions(packs.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def likely(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Pairs whose signatures allow the threshold. Cells that differ are at most the columns that one set has and the
    other hasn't, and at the threshold these are at most (100 - percent) / (100 + percent) of both sizes."""
    own = rows.select("doc_id", "n_shingles", "sign")
    one, two = (own.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("sign").alias(f"s{c}")).hint("merge") for c in "ab")
    # the cells of the longer signature fold onto those of the shorter one, whose number is half of it for sizes so alike
    half = lambda s: F.zip_with(F.slice(s, 1, F.shiftright(F.size(s), 1)), F.slice(s, F.shiftright(F.size(s), 1) + 1, F.shiftright(F.size(s), 1)), lambda x, y: x.bitwiseXOR(y))
    like = lambda s, t: F.when(F.size(s) > F.size(t), half(s)).otherwise(F.col(s))
    differ = F.aggregate(F.zip_with("ta", "tb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    both = pairs.join(one, "a").join(two, "b").withColumns({"ta": like("sa", "sb"), "tb": like("sb", "sa")})
    may = (F.size("ta") == F.size("tb")) & ((100 + percent) * differ <= (100 - percent) * (F.col("na") + F.col("nb")))
    if percent <= 50:  # sizes may be less alike
        may |= F.size("ta") != F.size("tb")
    return both.where(may).select("a", "b").distinct()


def counted(pairs: DataFrame, rows: DataFrame, docs: DataFrame, columns, n: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole sets meet the threshold."""
    cache = C.WordHashes()

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {"doc_id": batch.column("doc_id"), "columns": [columns.value.of(ngrams(t, n, cache)).view(np.int64) for t in C.as_bytes(batch.column("text"))]}

    pairs = C.staged(likely(pairs, rows, percent), "likely")
    nodes = C.staged(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct(), "nodes")
    # merge joins at every size: sides that happen to be small today are no reason for another plan
    near, _ = C.marked(docs, nodes)  # nodes are distinct; a semi join would be moved below the bitmap
    sets = C.mapped(near.join(nodes.hint("merge"), "doc_id"), step, "doc_id long, columns array<long>")
    overlap = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("columns").alias("x")).hint("merge"), "a")
        .join(sets.select(F.col("doc_id").alias("b"), F.col("columns").alias("y")).hint("merge"), "b")
        .where((100 + percent) * overlap >= percent * (F.size("x") + F.size("y")))
        .select("a", "b")
        .distinct()
    )


def linked(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links); one row for each row of docs."""
    keyed = C.keyed(docs).drop("tag")
    named = keyed.where("doc_id is not null")
    columns = docs.sparkSession.sparkContext.broadcast(Columns(frequent(named, n)))
    rows = C.staged(rows_of(keyed, columns, n, percent), "rows")
    known = rows.where("doc_id is not null and n_shingles > 0")
    key = ["n_shingles", "one", "two"]
    classes = known.groupBy(*key).agg(F.min(F.struct("doc_id", "firsts")).alias("least")).select("n_shingles", "least.*")
    made = C.staged(product(entries(classes), percent), "product")
    # written first, so that a class of very many copies is no key of an aggregate in the join's stage and can be split
    least = C.staged(known.groupBy(*key).agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n"), "copied")
    copies = known.select(*key, "doc_id").join(least.hint("merge"), key).select("a", F.col("doc_id").alias("b")).where("a <> b")
    first = C.staged(counted(made.where("kind = 0").select("a", "b").where("a <> b").distinct(), known, named, columns, n, percent), "links")
    roots = components(first)
    open_ = made.where("kind = 1").select(F.col("a").alias("column"), F.col("b").alias("doc"), "size", "place")
    open_ = C.staged(open_.join(roots, open_.doc == roots.node, "left").select("column", "doc", "size", "place", F.coalesce("root", "doc").alias("root")), "entries")
    mixed = open_.groupBy("column").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("column")
    open_ = C.staged(open_.join(mixed, "column", "left_semi"), "open")
    x, y = open_.alias("x"), open_.alias("y")
    overlap = F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place"))
    fits = (100 + percent) * overlap >= percent * (F.col("x.size") + F.col("y.size"))
    more = x.join(y, (F.col("x.column") == F.col("y.column")) & (F.col("x.root") < F.col("y.root")) & fits).select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct()
    more = C.staged(counted(more, known, named, columns, n, percent), "links")
    roots = components(first.union(more).union(copies))
    return rows.join(roots, rows.doc_id == roots.node, "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(C.table(spark, sf_dir, "documents"))


#: All pairs that share an n-gram; the closure of the links.
OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * o >= 85 * (p.n + q.n - o)),
r AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT b, root FROM r JOIN e ON e.a = r.node)
SELECT d.doc_id, cast(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node, min(root) AS root FROM r GROUP BY node) c ON c.node = d.doc_id
"""
