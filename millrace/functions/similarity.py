"""Similarity of column names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Types of a template column and the types of a source column that fit it.
TYPE_GROUPS = {
    "text": ("text", "code", "email", "phone", "unknown"),
    "code": ("code", "text", "unknown"),
    "email": ("email", "unknown"),
    "phone": ("phone", "unknown"),
    "date": ("date", "unknown"),
    "number": ("number", "money", "int", "unknown"),
    "int": ("int", "number", "money", "unknown"),
    "money": ("money", "number", "int", "unknown"),
}
FIT, CONFLICT = 15.0, -12.0


def tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, " "), lambda x: x != ""))


def token_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of the tokens of two normalized names, 0 to 100."""
    ta, tb = tokens(a), tokens(b)
    return F.when((F.size(ta) > 0) & (F.size(tb) > 0), F.size(F.array_intersect(ta, tb)) / F.size(F.array_union(ta, tb)) * 100.0).otherwise(0.0)


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit per character of a."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for ch in b:
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Share of characters left when only insertions and deletions count, 0 to 100."""
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def set_ratio(a: str, b: str) -> float:
    """The best of comparing what two token sets share with each of them, and both of them."""
    sa, sb = set(a.split()), set(b.split())
    if not sa or not sb:
        return 0.0
    both, left, right = (" ".join(sorted(x)) for x in (sa & sb, sa - sb, sb - sa))
    if both and (not left or not right):
        return 100.0
    gap = 1 if both else 0
    n_left, n_right = len(both) + gap + len(left), len(both) + gap + len(right)
    apart = len(left) + len(right) - 2 * common_length(left, right)
    best = 100.0 * (1 - apart / (n_left + n_right))
    if both:
        best = max(best, *(100.0 * (1 - (gap + len(rest)) / (len(both) + n)) for rest, n in ((left, n_left), (right, n_right))))
    return best


@F.pandas_udf(DoubleType())
def name_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """The largest of the three ratios of two normalized names. For the few pairs of column names, not for data."""
    return pd.Series([max(ratio(x, y), set_ratio(x, y), sort_ratio(x, y)) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)])


def type_bonus(template_type: Column, source_type: Column) -> Column:
    groups = F.create_map(*[x for k, v in TYPE_GROUPS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    group = F.try_element_at(groups, F.lower(template_type))
    known = template_type.isNotNull() & (template_type != "") & source_type.isNotNull() & ~source_type.isin("", "unknown")
    return F.when(known & group.isNotNull(), F.when(F.array_contains(group, source_type), FIT).otherwise(CONFLICT)).otherwise(0.0)


def pair_score(t: Column, s: Column, template_type: Column, source_type: Column, synonym: Column) -> Column:
    """t, s: normalized names. 100 for a synonym; else name, tokens and types, within 0 and 100."""
    score = 0.55 * name_score(t, s) + 0.30 * token_overlap(t, s) + type_bonus(template_type, source_type)
    return F.when(synonym, 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))
