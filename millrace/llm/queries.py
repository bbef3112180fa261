"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, html, jaccard, licenses, linechunks, neighbours, quality, substrings, suffixes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_licenses": licenses.op1_licenses,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_jaccard": jaccard.op3_jaccard,
        "op4_html": html.op4_html,
        "op5_bpe": bpe.op5_bpe,
        "op6_substrings": substrings.op6_substrings,
        "op7_linechunks": linechunks.op7_linechunks,
        "op8_neighbours": neighbours.op8_neighbours,
        "op9_quality": quality.op9_quality,
        "op10_suffixes": suffixes.op10_suffixes,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_licenses": licenses.OP1_SQL,
        "op2_decontaminate": decontaminate.OP2_SQL,
        "op3_jaccard": jaccard.OP3_SQL,
        "op6_substrings": substrings.OP6_SQL,
        "op7_linechunks": linechunks.OP7_SQL,
        "op8_neighbours": neighbours.OP8_SQL,
        "op10_suffixes": suffixes.OP10_SQL,
    }
