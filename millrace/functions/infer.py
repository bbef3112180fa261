"""Semantic types of values and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dates import parse_date
from .numbers import parse_number
from .text import strip

#: What hints at money, and the patterns of the other types.
MONEY_HINTS = ("đ", "₫", "$", "€", "£", "¥", "triệu", "tỷ", "ngàn", "nghìn", "vnđ")
EMAIL = r"(?U)^[\w.+-]+@[\w-]+(\.[\w-]+)+$"
PHONE = r"^[+]?[0-9 ]{7,15}$"
CODE = r"^[A-Za-z0-9_.-]+$"
SAMPLE = 20


def classify(c: Column, kind: Column | None = None) -> Column:
    """Type of a value: date, money, email, phone, number, code, text or unknown. kind: of a typed cell, `n` number, `b` boolean, `d` date."""
    s = strip(c)
    hint = F.lower(s).rlike("|".join(h.replace("$", r"\$") for h in MONEY_HINTS))
    text = (
        F.when(s.isNull() | (s == ""), "unknown")
        .when(parse_date(s).isNotNull(), "date")
        .when(hint, F.when(s.rlike("[0-9]"), "money").otherwise("unknown"))
        .when(s.rlike(EMAIL), "email")
        .when(s.rlike(PHONE), "phone")
        .when(parse_number(s).isNotNull(), "number")
        .when(s.rlike(CODE) & (F.length(s) <= 24), "code")
        .otherwise("text")
    )
    return text if kind is None else F.when(kind == "b", "unknown").when(kind == "n", "number").when(kind == "d", "date").otherwise(text)


def infer_types(samples: DataFrame, by: list[str], value: str = "value", order: str = "row_idx") -> DataFrame:
    """samples: at most SAMPLE values of each column (by), in order, with the kind of typed cells if given. Adds inferred: the commonest type, the first seen of
    equals, if it has two votes and half of all; else unknown."""
    votes = samples.where(F.col(value).isNotNull()).groupBy(*by, classify(F.col(value), F.col("kind") if "kind" in samples.columns else None).alias("type")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = votes.groupBy(*by).agg(F.max(F.struct("n", (-F.col("first")).alias("first"), "type")).alias("best"), F.sum("n").alias("total"))
    return best.select(*by, F.when(F.col("best.n") >= F.greatest(F.lit(2.0), F.col("total") * 0.5), F.col("best.type")).otherwise("unknown").alias("inferred"))
