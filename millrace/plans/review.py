"""Mappings to look over before a run: a preset where there is one, else what the names suggest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.matching import THRESHOLD, greedy, score_pairs
from .model import Template
from .pipeline import source_columns, template_rows
from .stores import find_presets


def proposed(recs: DataFrame, names: DataFrame, template: Template, presets: DataFrame | None = None, synonyms: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """group, mappings, from_preset for each file."""
    spark = recs.sparkSession
    sources = source_columns(recs, names)
    found = greedy(score_pairs(template_rows(spark, template), sources, synonyms), threshold).withColumnRenamed("mappings", "scored")
    if presets is None:
        return found.select("group", F.col("scored").alias("mappings"), F.lit(False).alias("from_preset"))
    cols = names.select(F.col("source_path").alias("group"), F.lit(template.path).alias("template_path"), F.col("names").alias("cols"))
    kept = find_presets(cols, presets).select("group", "mappings")
    return found.join(kept, "group").select("group", F.coalesce("mappings", "scored").alias("mappings"), F.col("mappings").isNotNull().alias("from_preset"))
