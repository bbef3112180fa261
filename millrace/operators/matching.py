"""Mapping of source columns to template columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import pair_score
from ..functions.text import normalize_name
from ..plans.model import MAPPING

THRESHOLD = 60.0


def score_pairs(template: DataFrame, sources: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """template: template_col, data_type, t_pos. sources: group, source_col, inferred, s_pos. Every pair of a group's columns with its score.

    The template is one small table by its nature (a sheet's header) and is broadcast; pairs are of column names only.
    synonyms: template_col, alias (normalized).
    """
    t = template.select("template_col", F.coalesce("data_type", F.lit("text")).alias("data_type"), "t_pos", normalize_name(F.col("template_col")).alias("t_norm"))
    s = sources.select("group", "source_col", "inferred", "s_pos", normalize_name(F.col("source_col")).alias("s_norm"))
    pairs = s.crossJoin(F.broadcast(t))
    if synonyms is None:
        pairs = pairs.withColumn("synonym", F.lit(False))
    else:
        known = synonyms.groupBy("template_col").agg(F.collect_set("alias").alias("aliases"))
        pairs = pairs.join(F.broadcast(known), "template_col", "left").withColumn("synonym", F.coalesce(F.array_contains("aliases", F.col("s_norm")), F.lit(False)))
    return pairs.withColumn("exact", (F.col("t_norm") == F.col("s_norm")).cast("int")).withColumn("score", pair_score(F.col("t_norm"), F.col("s_norm"), F.col("data_type"), F.col("inferred"), F.col("synonym")))


def greedy(pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """group, mappings: template columns in order take the best source that is left: an exact name first, else the highest score, else the earlier column."""
    each = F.struct((-F.col("exact")).alias("e"), (-F.col("score")).alias("n"), F.col("s_pos").alias("p"), F.col("source_col").alias("src"), F.col("score").alias("score"), F.col("synonym").alias("syn"))
    wanted = pairs.groupBy("group", "t_pos", "template_col").agg(F.array_sort(F.collect_list(each)).alias("found"))
    rows = wanted.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("t_pos", "template_col", "found"))).alias("wanted"))
    start = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast(f"array<{MAPPING}>").alias("out"))

    def step(state, want):
        best = F.try_element_at(F.filter(want["found"], lambda x: ~F.array_contains(state["used"], x["src"])), F.lit(1))
        taken = best.isNotNull() & ((best["e"] == -1) | (best["score"] >= threshold))
        score = F.when(best["e"] == -1, 100.0).otherwise(best["score"])
        label = F.when(best["syn"], "synonym").when(score >= 99.9, "exact").otherwise("fuzzy")
        mapping = F.struct(want["template_col"].alias("template_col"), F.when(taken, best["src"]).alias("source_col"), F.when(taken, label).otherwise("unmapped").alias("match_source"), F.when(taken, F.round(score, 1)).otherwise(0.0).alias("confidence"))
        used = F.when(taken, F.concat(state["used"], F.array(best["src"]))).otherwise(state["used"])
        return F.struct(used.alias("used"), F.concat(state["out"], F.array(mapping)).cast(f"array<{MAPPING}>").alias("out"))

    return rows.select("group", F.aggregate("wanted", start, step, lambda s: s["out"]).alias("mappings"))


def unmapped_sources(sources: DataFrame, mappings: DataFrame) -> DataFrame:
    """group, extra: source columns in order that no mapping uses."""
    cols = sources.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("s_pos", "source_col"))), lambda x: x["source_col"]).alias("cols"))
    return cols.join(mappings, "group").select("group", F.array_except("cols", F.transform("mappings", lambda m: m["source_col"])).alias("extra"))
