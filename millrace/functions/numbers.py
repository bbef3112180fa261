"""Numbers written in mixed conventions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

_CURRENCY = r"(?U)\s*[₫$€£¥₹]\s*"
_FLOAT = r"^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?$"
#: Stands for a decimal comma while dots and other commas are dealt with.
_MARK = "\x01"


def parse_number(c: Column, strip_currency: bool = True) -> Column:
    """A double, or null.

    The later one of a comma and a dot is the decimal mark; a mark that repeats groups thousands; a single comma
    groups thousands and a single dot is decimal. Parentheses around the whole negate.
    """
    s = strip(c)
    if strip_currency:
        s = F.regexp_replace(F.translate(s, "đ₫", ""), _CURRENCY, "")
    sign = F.when(s.rlike(r"^\(.*\)$"), -1.0).otherwise(1.0)
    s = F.translate(F.regexp_replace(s, r"^[()]+|[()]+$", ""), " ", "")
    marked = F.regexp_replace(s, r"^(.*\..*),([^.,]*)$", f"$1{_MARK}$2")
    marked = F.regexp_replace(marked, rf"\.(?=.*{_MARK})|,(?!.*{_MARK})", "")
    plain = F.when(s.rlike(r"^[^,]*\.[^,]*\.[^,]*$"), F.translate(s, ".", "")).otherwise(F.translate(marked, _MARK, "."))
    return F.translate(F.regexp_extract(plain, _FLOAT, 0), "_", "").try_cast("double") * sign


def truncated(c: Column) -> Column:
    """Toward zero; null beyond 64 bits."""
    return F.when(F.abs(c) < 9.223372036854775e18, c.cast("long"))
