"""Files as raw grids: discovery, format dispatch, decoding on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.header import CELL
from . import decode, xls

#: Extensions by how they are read.
ENGINES = {"xlsx": "workbook", "xlsm": "workbook", "xls": "legacy", "csv": "csv"}
IMAGES = ("jpg", "jpeg", "png", "bmp", "tiff", "tif", "webp")
DOCUMENTS = ("pdf", *IMAGES)
SCHEMA = f"source_path string, sheet string, sheet_idx int, row_idx bigint, cells array<{CELL}>, error string"


class BackendMissing(RuntimeError):
    """A reader whose library isn't installed."""


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def engine(path: Column) -> Column:
    """How a path is read: workbook, legacy, csv, document; null if it isn't."""
    e = extension(path)
    kinds = F.create_map(*[F.lit(x) for k, v in {**ENGINES, **dict.fromkeys(DOCUMENTS, "document")}.items() for x in (k, v)])
    return F.try_element_at(kinds, e)


def discover(spark: SparkSession, folder: str, recursive: bool = False, kinds: tuple[str, ...] = (*ENGINES, *DOCUMENTS)) -> DataFrame:
    """path, length, content of the files of a folder that can be read, each once; folders of part files are found by entries()."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.where(extension(F.col("path")).isin(*kinds)).select("path", "length", "content")


def entries(spark: SparkSession, folder: str, recursive: bool = False, kinds: tuple[str, ...] = (*ENGINES, *DOCUMENTS)) -> DataFrame:
    """path, length of what stands in a folder under one of the extensions, each once: a file, or a folder of part files, as Spark
    writes a table (also one with folders for its partitions). Files are listed, not read; a path that a store alone resolves will do."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    parts = F.split(F.substr("path", F.lit(len(root) + 2)), "/")
    files = files.select("length", parts.alias("parts"), F.transform(parts if recursive else F.slice(parts, 1, 1), lambda x: extension(x).isin(*kinds)).alias("of_kind"))
    found = files.withColumn("k", F.array_position("of_kind", F.lit(True)).cast("int")).where("k > 0")
    return found.groupBy(F.concat_ws("/", F.lit(root), F.slice("parts", F.lit(1), F.col("k"))).alias("path")).agg(F.sum("length").alias("length"))


def grids(files: DataFrame, encoding: str = "utf-8-sig", documents: Callable[[str, bytes], Iterator[list]] | None = None) -> DataFrame:
    """Rows of all sheets of the files, in order, each file decoded once. A file that fails gives one row with its error.

    A file is decoded by one task as a stream; batches of rows leave it as they fill. documents: a reader of PDF and image files
    (path, bytes) -> rows of cells; without one these files report that the backend is missing.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def sheets(path: str, data: bytes) -> Iterator[tuple[str, int, Iterator[list]]]:
        kind = ENGINES.get(path.rsplit(".", 1)[-1].lower())
        if kind == "csv":
            yield decode.CSV_SHEET, 0, decode.csv_rows(data, encoding)
        elif kind == "workbook":
            for i, (name, part) in enumerate(decode.sheet_names(data)):
                yield name, i, decode.xlsx_rows(data, part)
        elif kind == "legacy":
            yield from xls.sheets(data)
        elif documents is not None and path.rsplit(".", 1)[-1].lower() in DOCUMENTS:
            yield "Nội dung", 0, documents(path, data)
        elif path.rsplit(".", 1)[-1].lower() in DOCUMENTS:
            raise BackendMissing(f"no backend installed for {path}")
        else:
            raise ValueError(f"unsupported format: {path}")

    def rows(path: str, data: bytes) -> Iterator[tuple]:
        try:
            for name, i, own in sheets(path, data):
                for k, cells in enumerate(own):
                    yield path, name, i, k, [None if c is None else dict(zip(("kind", "s", "d"), c, strict=True)) for c in cells], None
        except Exception as e:  # noqa: BLE001  a broken file is a failed report, not a failed batch
            yield path, None, None, None, None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                for row in rows(path, data.as_buffer().to_pybytes() if data.is_valid else b""):
                    held.append(row)
                    if len(held) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)
                        held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def large_csv(spark: SparkSession, path: str, encoding: str = "utf-8") -> tuple[DataFrame, DataFrame]:
    """Records and names, as the pipeline takes them, of one CSV file of any size, read in parallel by blocks of lines.

    For files that one task can't hold. The first line is the header; no quoted value may hold a line break; cells beyond the
    header are cut. Rows are numbered by their place in the file: only the number of rows of each block reaches the driver.
    """
    raw = spark.read.options(header=True, encoding=encoding, mode="PERMISSIVE", enforceSchema=True, escape='"', nullValue="\0").csv(path)
    names = raw.columns
    # every column is read, whatever is asked for: a block must have as many rows in both passes
    rows = raw.select(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid"), F.array(*[F.col(f"`{n}`") for n in names]).alias("cells"))
    blocks = rows.groupBy("block").agg(F.min("mid").alias("first"), F.count("*").alias("n"), F.max(F.size("cells"))).orderBy("block").collect()
    starts, total = [], 0
    for b in blocks:
        starts.append((b.block, b.first, total))
        total += b.n
    at = spark.createDataFrame(starts, "block long, first long, start long")
    cells = F.transform("cells", lambda x: F.when(~x.isin(*decode.NULLS), x))
    recs = rows.join(F.broadcast(at), "block").select(F.lit(path).alias("source_path"), F.lit(decode.CSV_SHEET).alias("sheet"), (F.col("mid") - F.col("first") + F.col("start")).alias("row_idx"), F.map_from_arrays(F.array(*map(F.lit, names)), cells).alias("values"))
    return recs, spark.createDataFrame([(path, decode.CSV_SHEET, names, 0)], "source_path string, sheet string, names array<string>, duplicates int")
