"""From files to the standardized table, the issue log and the reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.infer import infer_types
from ..operators import header as H
from ..operators.clean import apply_rules, issue_log, merged
from ..operators.matching import greedy, score_pairs, unmapped_sources
from ..operators.report import batch_report, file_reports
from ..sources.files import grids
from .staging import materialized
from .model import MAPPING, NUMBER_TYPES, Mapping, Settings, Template


@dataclass
class Result:
    table: DataFrame
    cleaned: DataFrame
    issues: DataFrame
    mappings: DataFrame
    reports: DataFrame
    batch: DataFrame


def template_rows(spark: SparkSession, template: Template) -> DataFrame:
    return spark.createDataFrame([(c.name, c.data_type, c.order) for c in template.columns], "template_col string, data_type string, t_pos int")


def source_columns(recs: DataFrame, names: DataFrame) -> DataFrame:
    """group, source_col, s_pos, inferred of each file. names: source_path, sheet, names."""
    cols = names.select(F.col("source_path"), F.posexplode("names").alias("s_pos", "source_col"))
    types = infer_types(H.samples(recs, blanks=True), ["source_path", "name"])
    joined = cols.join(types, (cols.source_path == types.source_path) & (cols.source_col == types.name), "left")
    return joined.select(cols.source_path.alias("group"), "source_col", "s_pos", F.coalesce("inferred", F.lit("unknown")).alias("inferred"))


def overridden(mappings: DataFrame, override: list[Mapping], sources: DataFrame) -> DataFrame:
    """The given mappings for every file; a source that a file hasn't got is unmapped there."""
    cols = sources.groupBy("group").agg(F.collect_set("source_col").alias("cols"))
    given = F.array(*[F.struct(F.lit(m.template_col).alias("template_col"), F.when(F.array_contains("cols", m.source_col or ""), F.lit(m.source_col)).alias("source_col"), F.when(F.array_contains("cols", m.source_col or ""), m.match_source).otherwise("unmapped").alias("match_source"), F.when(F.array_contains("cols", m.source_col or ""), float(m.confidence)).otherwise(0.0).alias("confidence")) for m in override])
    return cols.select("group", given.cast(f"array<{MAPPING}>").alias("mappings"))


def suggested(mappings: DataFrame, sources: DataFrame, template: Template, suggester, aggressive: bool = False) -> DataFrame:
    """Mappings completed by a provider, asked once for each distinct header; each source is used once.

    Only names and types of columns whose header isn't fully matched reach the driver and the provider, as many rows as
    there are distinct headers. aggressive: fuzzy mappings under 75 may be replaced by a free source.
    """
    spark = mappings.sparkSession
    heads = sources.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("s_pos", "source_col", "inferred"))).alias("head"))
    open_ = mappings.join(heads, "group").where(F.exists("mappings", lambda m: m["source_col"].isNull() | ((m["match_source"] == "fuzzy") & (m["confidence"] < 75) & F.lit(aggressive))))
    signature = F.transform("head", lambda h: F.struct(h["source_col"], h["inferred"]))
    types, out = {c.name: c.data_type or "text" for c in template.columns}, []
    for r in open_.groupBy(signature.alias("cols"), "mappings").agg(F.count("*")).toLocalIterator():
        rows = [m.asDict() for m in r.mappings]
        used = {m["source_col"] for m in rows if m["source_col"] is not None}
        free = {c.source_col: c.inferred for c in r.cols if c.source_col not in used}
        asked = [m for m in rows if m["source_col"] is None or (aggressive and m["match_source"] == "fuzzy" and m["confidence"] < 75)]
        answer = suggester.suggest([m["template_col"] for m in asked], list(free), types, free) if free else None
        for m in asked:
            source = (answer or {}).get(m["template_col"])
            if source in free:
                m |= {"source_col": source, "match_source": "ai", "confidence": 90.0}
                del free[source]
        out.append(([(c.source_col, c.inferred) for c in r.cols], [tuple(m.values()) for m in rows]))
    if not out:
        return mappings
    new = spark.createDataFrame(out, f"cols array<struct<source_col: string, inferred: string>>, better array<{MAPPING}>")
    joined = mappings.join(heads.select("group", signature.alias("cols")), "group").join(F.broadcast(new), "cols", "left")
    fits = F.col("better").isNotNull() & (F.transform("mappings", lambda m: m["template_col"]) == F.transform("better", lambda m: m["template_col"]))
    return joined.select("group", F.when(fits, F.col("better")).otherwise(F.col("mappings")).alias("mappings"))


def standardize_records(recs: DataFrame, names: DataFrame, template: Template, settings: Settings | None = None, synonyms: DataFrame | None = None, suggester=None, override: list[Mapping] | None = None) -> Result:
    """recs: source_path, sheet, row_idx, values (map), and typed (map) if cells are typed. All files go through one select: a row's value of a template column is looked
    up by its file's mapping, which joins as a small table."""
    settings = settings or Settings()
    spark = recs.sparkSession
    sources = materialized(source_columns(recs, names), "sources")
    mappings = greedy(score_pairs(template_rows(spark, template), sources, synonyms), settings.fuzzy_threshold)
    if override:
        mappings = overridden(mappings, override, sources)
    elif suggester is not None and suggester.available:
        mappings = suggested(mappings, sources, template, suggester, settings.ai.aggressive)
    mappings = materialized(mappings, "mappings")
    used = F.filter("mappings", lambda m: m["source_col"].isNotNull())
    lookup = mappings.select(F.col("group").alias("source_path"), F.map_from_entries(F.transform(used, lambda m: F.struct(m["template_col"], m["source_col"]))).alias("lookup"))
    # of the typed cells only what a template column of a type needs: dates and numbers
    own = F.map_filter("lookup", lambda t, _: t.isin(*[c.name for c in template.columns if (c.data_type or "").lower() in ("date", *NUMBER_TYPES)]))
    typed = [F.map_filter(F.transform_values(own, lambda _, s: F.try_element_at("typed", s)), lambda _, x: x.isNotNull()).alias("typed")] if "typed" in recs.columns else []
    wide = recs.join(lookup, "source_path").select("source_path", "row_idx", F.map_keys("lookup").alias("mapped"), *[t.alias("__typed") for t in typed], *[F.try_element_at("values", F.try_element_at("lookup", F.lit(n))).alias(n) for n in template.names])
    identity = [Mapping(n, n, "exact", 100.0) for n in template.names]
    # the table, the issues and the reports all come from it: every row is cleaned once
    cleaned = materialized(apply_rules(wide, template, identity, settings.clean, keep=("source_path",), mapped="mapped", typed="__typed" if typed else None), "cleaned")
    log = lambda df, col, severity, kind, message: df.select("source_path", F.lit(0).cast("long").alias("row"), F.col(col).alias("column"), F.lit(severity).alias("severity"), F.lit(kind).alias("type"), F.lit(message).alias("message"), F.lit(None).cast("string").alias("value"))
    extra = log(unmapped_sources(sources, mappings).select(F.col("group").alias("source_path"), F.explode("extra").alias("c")), "c", "warning", "extra_column", "Source column isn't in the template")
    missing = log(mappings.select(F.col("group").alias("source_path"), F.explode(F.filter("mappings", lambda m: m["source_col"].isNull())).alias("m")).select("source_path", F.col("m.template_col").alias("c")), "c", "error", "unmapped_column", "No source column found")
    issues = extra.union(missing).union(issue_log(cleaned, ("source_path",)))
    if "duplicates" in names.columns:
        issues = issues.union(log(names.where("duplicates > 0").withColumn("c", F.lit("")), "c", "warning", "duplicate_header", "Repeated column names were numbered"))
    counts = recs.groupBy("source_path").agg(F.count("*").alias("row_count"))
    files = mappings.select(F.col("group").alias("source_path"), F.size(used).alias("mapped_columns"), F.transform(F.filter("mappings", lambda m: m["source_col"].isNull()), lambda m: m["template_col"]).alias("unmapped_columns")).join(counts, "source_path", "left").withColumn("error_message", F.lit(""))
    reports = file_reports(files, issues)
    return Result(merged(cleaned, template, ("source_path",)), cleaned, issues, mappings, reports, batch_report(reports))


def read_records(grid: DataFrame, sheet: str | None = None, header_row: int | None = None, skip_rows: int = 0) -> tuple[DataFrame, DataFrame]:
    """Records and names of each file's sheet (the given or the best one); transposed sheets are turned. The grid is read many times:
    it should be a written table. What is found of each file (its sheet and orientation) is a small table, written once."""
    grid = grid.where("cells is not null")
    chosen = grid.where(F.col("sheet") == sheet) if sheet else grid.join(H.best_sheets(grid).select("source_path", "sheet"), ["source_path", "sheet"], "left_semi")
    turned = materialized(H.transposed(chosen), "sheets")
    straight = grid.join(turned.where("not transposed"), ["source_path", "sheet"], "left_semi")
    across = grid.join(turned.where("transposed"), ["source_path", "sheet"], "left_semi")
    heads = H.resolved_headers(straight, header_row, skip_rows)
    recs = H.records(straight, heads).union(H.transposed_records(across))
    labels = across.groupBy("source_path", "sheet").agg(F.array_sort(F.collect_list(F.struct("row_idx", F.try_element_at("cells", F.lit(1)).alias("c")))).alias("r"))
    labels = labels.select("source_path", "sheet", H.unique_names(H.clean_header(F.transform("r", lambda x: x["c"]))).alias("names"), F.lit(0).alias("duplicates"))
    return recs, heads.select("source_path", "sheet", "names", "duplicates").union(labels)


def standardize(files: DataFrame, template: Template, settings: Settings | None = None, synonyms: DataFrame | None = None, suggester=None, override: list[Mapping] | None = None, sheet: str | None = None, header_row: int | None = None, skip_rows: int = 0, documents=None) -> Result:
    """files: path, content. Files are decoded once; those that fail or hold no data are in the reports with their message."""
    settings = settings or Settings()
    grid = materialized(grids(files, documents=documents), "grid")
    recs, names = read_records(grid, sheet or settings.default_sheet, header_row, skip_rows or settings.default_skip_rows)
    recs, names = materialized(recs, "records"), materialized(names, "names")
    out = standardize_records(recs, names, template, settings, synonyms, suggester, override)
    empty = files.select(F.col("path").alias("source_path")).join(recs.select("source_path").distinct(), "source_path", "left_anti")
    broken = empty.join(grid.where("error is not null").select("source_path", "error"), "source_path", "left")
    failed = broken.select("source_path", F.lit(0).alias("mapped_columns"), F.array().cast("array<string>").alias("unmapped_columns"), F.lit(0).cast("long").alias("row_count"), F.coalesce("error", F.lit("The file holds no data")).alias("error_message"), F.lit(0).cast("long").alias("error_count"), F.lit(0).cast("long").alias("warning_count"), F.lit("failed").alias("status"))
    out.reports = out.reports.join(failed.select("source_path"), "source_path", "left_anti").unionByName(failed)
    out.batch = batch_report(out.reports)
    return out


def load_template(spark: SparkSession, path: str, sheet: str | None = None, skip_rows: int = 0) -> Template:
    """The template of a file's header: the given or the first sheet, with the sidecar's additions."""
    from .model import load_meta, template_of

    grid = grids(spark.read.format("binaryFile").load(path)).where("cells is not null")
    own = grid.where(F.col("sheet") == sheet) if sheet else grid.where("sheet_idx = 0")
    turned = own.join(H.transposed(own).where("transposed"), ["source_path", "sheet"], "left_semi")
    rows = turned.orderBy("row_idx").select(F.try_element_at("cells", F.lit(1)).alias("c")).collect()
    if rows:
        names = turned.groupBy().agg(F.array_sort(F.collect_list(F.struct("row_idx", F.try_element_at("cells", F.lit(1)).alias("c")))).alias("r")).select(H.unique_names(H.clean_header(F.transform("r", lambda x: x["c"]))).alias("names")).first().names
    else:
        names = H.resolved_headers(own, skip_rows=skip_rows).first().names
    return template_of(names, path, sheet).with_meta(load_meta(path))
