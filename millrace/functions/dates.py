"""Dates written in mixed conventions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

_DAY, _MONTH = r"(3[01]|[12]\d|0[1-9]|[1-9])", r"(1[0-2]|0[1-9]|[1-9])"
_YMD, _DMY = rf"^(\d{{4}}){_MONTH}{_DAY}", rf"^{_DAY}{_MONTH}(\d{{4}})"
#: Conventions in the order in which they are tried, by what parts the text: a slash, a dash, a dot, a space.
_SLASH, _DASH = ("d/M/yyyy", "M/d/yyyy", "yyyy/M/d", "d/M/yy", "M/d/yy", "d/MMM/yyyy", "d/MMMM/yyyy"), ("yyyy-M-d", "d-M-yyyy", "d-MMM-yyyy", "d-MMMM-yyyy", "M-d-yyyy")
_DOT, _BLANK = ("d.M.yyyy", "M.d.yyyy"), ("d MMM yyyy", "d MMMM yyyy")
_ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"
_STRFTIME = {"%d": "dd", "%m": "MM", "%Y": "yyyy", "%y": "yy", "%H": "HH", "%M": "mm", "%S": "ss", "%b": "MMM", "%B": "MMMM", "%f": "SSSSSS", "%j": "DDD", "%I": "hh", "%p": "a", "%%": "%"}


def _first(s: Column, patterns: tuple[str, ...]) -> Column:
    """The date by the first pattern that fits; two digits of a year from 69 on are 19xx."""
    found = []
    for p in patterns:
        d = F.try_to_date(s, p)
        found.append(F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d) if p.endswith("/yy") else d)
    return F.coalesce(*found)


def parse_date(c: Column) -> Column:
    """A timestamp without zone, or null. Day before month where both can be.

    Beyond the listed conventions: ISO date-times (their wall time), names of months in full, month first with dashes or dots
    where day first gives no date, and years alone. Words and clock times that would mean today are no dates. A text is looked
    at by what parts it, so that few patterns are tried.
    """
    s = F.initcap(strip(c))
    compact = F.coalesce(F.try_to_date(F.regexp_replace(s, _YMD, "$1-$2-$3"), "yyyy-M-d"), F.try_to_date(F.regexp_replace(s, _DMY, "$3-$2-$1"), "yyyy-M-d"))
    iso = F.regexp_replace(F.upper(s), r"(Z|[+-]\d{2}:?\d{2})$", "").try_cast("timestamp_ntz")
    year = F.when(s.between("1678", "2262"), F.try_to_date(s, "yyyy"))
    return (
        F.when(s.contains(":"), F.when(F.upper(s).rlike(_ISO), iso))
        .when(s.contains("/"), _first(s, _SLASH).cast("timestamp_ntz"))
        .when(s.contains("-"), _first(s, _DASH).cast("timestamp_ntz"))
        .when(s.contains("."), _first(s, _DOT).cast("timestamp_ntz"))
        .when(s.contains(" "), _first(F.regexp_replace(s, " +", " "), _BLANK).cast("timestamp_ntz"))
        .when(s.rlike(r"^\d{5,8}$"), compact.cast("timestamp_ntz"))
        .when(s.rlike(r"^\d{4}$"), year.cast("timestamp_ntz"))
    )


def excel_date(days: Column) -> Column:
    """Days since 1899-12-30, with fractions, as a timestamp without zone; null out of range."""
    return F.when(days.between(-693593, 2958465.999999), F.timestamp_add("SECOND", F.round(days * 86400).cast("long"), F.lit("1899-12-30").cast("timestamp_ntz")))


def pattern(strftime: str) -> str:
    """A strftime format as a pattern of date_format."""
    out, i = "", 0
    while i < len(strftime):
        two = strftime[i : i + 2]
        if two in _STRFTIME:
            out, i = out + _STRFTIME[two], i + 2
        else:
            out, i = out + (f"'{strftime[i]}'" if strftime[i].isalpha() else strftime[i]), i + 1
    return out


def format_date(c: Column, strftime: str = "%d/%m/%Y") -> Column:
    return F.date_format(c, pattern(strftime))
