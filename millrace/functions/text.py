"""Text functions: white space, case, Unicode folding. Columns in, columns out."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Python's str.strip() also takes four ASCII separators that Unicode doesn't call white space.
_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGES, "")


def is_empty(c: Column) -> Column:
    """Null or blank."""
    return c.isNull() | (strip(c) == "")


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Unicode compatibility composition; Spark has no function for it."""
    return values.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFKC", v))


@lru_cache
def _folds() -> tuple[str, str]:
    """Characters of the basic plane that decompose to one character and marks, and that character."""
    source, target = [], []
    for code in range(0xC0, 0xFFFF):
        parts = [x for x in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(x)] if not 0xD800 <= code < 0xE000 else []
        if len(parts) == 1 and parts[0] != chr(code) and ord(parts[0]) < 0xFFFF <= sys.maxunicode:
            source.append(chr(code))
            target.append(parts[0])
    return "".join(source), "".join(target)


def fold_marks(c: Column) -> Column:
    """Without diacritics, by translate() alone; letters that don't decompose (đ) stay."""
    source, target = _folds()
    return F.regexp_replace(F.translate(c, source, target), r"\p{M}", "")


def normalize_name(c: Column) -> Column:
    """Column name for comparison: no diacritics, lower case, `_` and `-` as spaces, single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(strip(fold_marks(c))), "_-", "  "), r"(?U)\s+", " "))


def plain_name(name: str) -> str:
    """normalize_name() of one name at hand."""
    source, target = _folds()
    folded = "".join(x for x in name.strip().translate(str.maketrans(source, target)) if not unicodedata.category(x).startswith("M"))
    return " ".join(folded.lower().translate(str.maketrans("_-", "  ")).split())


def title(c: Column) -> Column:
    """A capital after anything that is no letter, small letters elsewhere."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1)), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(x.substr(F.lit(2), F.length(x))))), "")


def clean_text(c: Column, trim: bool = True, normalize_unicode: bool = True, case: str = "none") -> Column:
    if normalize_unicode:
        c = nfkc(c)
    if trim:
        c = strip(c)
    return {"upper": F.upper, "lower": F.lower, "title": title}.get(case, lambda x: x)(c)
