"""Small tables that outlive a run: synonyms and mapping presets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_name

SYNONYMS = "template_col string, alias string"
PRESETS = "key string, mappings array<struct<template_col: string, source_col: string, match_source: string, confidence: double>>"


def add_synonyms(store: DataFrame, new: DataFrame) -> DataFrame:
    """store with the aliases of new (template_col, alias) in normalized form, each once."""
    return store.union(new.select("template_col", normalize_name(F.col("alias")).alias("alias")).where("alias <> ''")).distinct()


def learned(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pairs that a user changed: template_col, alias of mappings in after that before has otherwise."""
    b = before.select("template_col", F.col("source_col").alias("was"))
    return after.join(b, "template_col", "left").where("source_col is not null and not (source_col <=> was)").select("template_col", F.col("source_col").alias("alias"))


def preset_key(template_path: Column, source_cols: Column) -> Column:
    """Key of a template and a set of source columns; their order doesn't matter."""
    return F.sha2(F.concat(template_path, F.lit("::"), F.array_join(F.array_sort(F.transform(source_cols, normalize_name)), "|")), 256)


def put_preset(store: DataFrame, new: DataFrame) -> DataFrame:
    return store.join(new, "key", "left_anti").unionByName(new)


def find_presets(sources: DataFrame, store: DataFrame) -> DataFrame:
    """sources (template_path, cols, ...) with the mappings of their preset, null without one."""
    return sources.withColumn("key", preset_key(F.col("template_path"), F.col("cols"))).join(store, "key", "left")


def valid_manual(mappings: Column) -> Column:
    """Whether no source column is used twice."""
    used = F.filter(F.transform(mappings, lambda m: m["source_col"]), lambda x: x.isNotNull())
    return F.size(F.array_distinct(used)) == F.size(used)
