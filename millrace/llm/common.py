"""What the operators of this subpackage share: batches, word splitting, rolling hashes, staging."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that one vectorized step handles; bounds a worker's memory.
STEP = 1 << 20

U64 = np.uint64

# Workers live on between tasks: let what they free go back to the system (M_MMAP_THRESHOLD and M_TRIM_THRESHOLD of glibc).
pa.set_memory_pool(pa.system_memory_pool())
with contextlib.suppress(AttributeError, OSError):
    for _option in (-3, -1):
        ctypes.CDLL(None).mallopt(_option, 1 << 18)


# ---------------------------------------------------------------- Spark side


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. On one machine a temporary folder serves where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at and spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        at = f"{tempfile.gettempdir()}/millrace-{spark.sparkContext.applicationId}"
    if not at:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return at.rstrip("/")


def staged(df: DataFrame, name: str, large: bool = False) -> DataFrame:
    """df written as Parquet to the shared folder and read again; cuts the lineage. large: the shuffle files behind it are
    dropped at once, not only when the driver next collects its garbage."""
    spark, schema = df.sparkSession, df.schema
    at = f"{shared_dir(spark)}/millrace/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    if large and not spark.sparkContext.master.startswith("local["):  # where driver and executors are one, its files go with its garbage
        del df
        gc.collect()
        spark._jvm.System.gc()
    return spark.read.schema(schema).parquet(at)


def clear(spark: SparkSession) -> None:
    """Removes what this application has staged; for after the results are written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/millrace/{spark.sparkContext.applicationId}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def keyed(docs: DataFrame, carry: list[str] | None = None, several: DataFrame | None = None) -> DataFrame:
    """doc_id, tag, text: the only columns the operators read, whatever else docs holds.

    tag is 0 but for the rows of a doc_id that stands with other texts too (several): there it is the 64-bit hash of
    the text. A null text is empty. carry: columns to take along, in a struct of that name.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carry")] if carry else []))
    rest = own.columns[1:]
    if several is None:
        return own.select("doc_id", F.lit(0).cast("long").alias("tag"), *rest)
    return own.join(several.withColumn("again", F.lit(True)), "doc_id", "left").select("doc_id", F.when(F.col("again"), F.xxhash64("text")).otherwise(F.lit(0)).cast("long").alias("tag"), *rest)


#: doc_ids with different texts that are broadcast (8 bytes each); beyond, they are joined by a shuffle.
SEVERAL = 1 << 20


def several(docs: DataFrame) -> DataFrame | None:
    """The doc_ids that stand with different texts, for keyed(); None if there are none, as should be."""
    rows = keyed(docs).where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("h"))
    found = staged(rows.groupBy("doc_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("doc_id"), "several")
    n = found.count()
    return None if not n else F.broadcast(found) if n <= SEVERAL else found.hint("merge")


def carried(schema: str, frame: DataFrame) -> StructType:
    """A schema, with the struct of the columns taken along if the frame has one."""
    kind = StructType.fromDDL(schema)
    return kind.add("carry", frame.schema["carry"].dataType) if "carry" in frame.columns else kind


def taken(batch: pa.RecordBatch) -> dict:
    return {"carry": batch.column("carry")} if "carry" in batch.schema.names else {}


#: Bits of a bitmap of doc_ids (4 MB), whatever their number.
BITMAP = 1 << 25


def marked(docs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs in two: the rows whose doc_id may be among those of nodes, and the rows whose doc_id isn't.

    A bitmap of the nodes' hashes, of bounded size, is broadcast, so that a join with what is known of some documents need
    not shuffle the texts of all. More nodes than it has bits for only send more rows to the first part.
    """
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP))
    bits = staged(nodes.groupBy(F.shiftright(cell, 15).alias("__of")).agg(F.bitmap_construct_agg(cell.bitwiseAND(32767)).alias("__bits")), "bitmap")
    at = docs.withColumn("__cell", cell).join(F.broadcast(bits), F.shiftright("__cell", 15) == F.col("__of"), "left")
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(shiftright(__cell & 32767, 3) as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.call_function("getbit", byte, F.col("__cell").bitwiseAND(7).cast("int")), F.lit(0)) == 1
    return at.where(hit).select(*docs.columns), at.where(~hit).select(*docs.columns)


# ---------------------------------------------------------------- batches


def mapped(df: DataFrame, step: Callable[[pa.RecordBatch], Iterator[dict]], schema: str | StructType, limit: int = 4 * STEP) -> DataFrame:
    """step over pieces of at most `limit` bytes of text (or one row); it yields dicts of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, limit):
                for out in step(piece):
                    yield record(out, arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)
    return df.mapInArrow(run, kind)


def record(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    def of(c, kind: pa.DataType) -> pa.Array:
        if isinstance(c, pa.Array):
            return c if c.type == kind else c.cast(kind)  # columns taken along may differ in zone or nullability
        return pa.array(c, kind)

    return pa.RecordBatch.from_arrays([of(columns[f.name], f.type) for f in schema], schema=schema)


def pieces(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with at most `limit` bytes of text each, or one row."""
    if "text" not in batch.schema.names:
        yield batch
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """Runs of equal key in batches sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and keys[a] != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield last, pa.Table.from_batches(held)


# ---------------------------------------------------------------- words

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Lower-cases A-Z and turns every other ASCII byte but 0-9 and a-z into a space.
_FOLD = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fold(text: bytes) -> bytes:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z in lower case, apart by spaces."""
    return text.translate(_FOLD)


def lower(text: bytes) -> bytes:
    return text.translate(_LOWER)


def cut(text: bytes, limit: int = STEP) -> Iterator[bytes]:
    """Parts of about `limit` bytes that end before white space, so that no word is cut."""
    at = 0
    while len(text) - at > limit:
        found = _SPACE.search(text, at + limit)
        to = found.start() if found else len(text)
        yield text[at:to]
        at = to
    yield text[at:] if at else text


class WordHashes(dict):
    """64-bit hash of each word, kept for the words seen last; bounded."""

    MOST = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def hashes(text: bytes, cache: WordHashes) -> np.ndarray:
    """Hashes of the white-space words of a text."""
    parts = [np.fromiter(map(cache.__getitem__, words), U64, len(words)) for part in cut(text) if (words := part.split())]
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, U64)


# ---------------------------------------------------------------- rolling hashes

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base modulo 2^64 and of its inverse."""
    if which not in _powers or len(_powers[which][0]) < n:
        size, pair = 1 << max(16, (n - 1).bit_length()), []
        for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            p = np.full(size, base, U64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            pair.append(p)
        _powers[which] = tuple(pair)
    return _powers[which]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(32))) * U64(0xE9846AF9B1A615D5)
    x = (x ^ (x >> U64(32))) * U64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> U64(29))


class Rolling:
    """Hashes of any spans of one array of 64-bit values, by prefix sums of value * base^position."""

    def __init__(self, values: np.ndarray, which: int = 0):
        self.pw, self.inv = powers(which, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * self.pw[: len(values)], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inv[start])

    def every(self, length: int) -> np.ndarray:
        """Of each span of this length, by its start."""
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.inv[:n]) if n > 0 else np.empty(0, U64)


#: Random-looking 64-bit values for the 256 bytes, by a rule.
BYTE_VALUES = tuple(mix(np.arange(1, 257, dtype=U64) * U64(salt)) for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25))


# ---------------------------------------------------------------- spans


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans as maximal runs, in order; spans that touch are one run."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.r_[True, s[1:] > e[:-1]])
    return s[first], e[np.r_[first[1:] - 1, len(e) - 1]]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] of them, one after the other."""
    total = int(counts.sum())
    return np.arange(total) + np.repeat(starts - np.r_[0, np.cumsum(counts)[:-1]], counts) if total else np.empty(0, np.int64)
