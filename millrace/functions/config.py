"""Settings values: paths of two platforms, base URLs, typed defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MOUNT, _DRIVE = r"^/mnt/([a-zA-Z])/(.*)$", r"^([a-zA-Z]):/(.*)$"


def _slashes(c: Column) -> Column:
    return F.translate(c, "\\", "/")


def to_posix(c: Column) -> Column:
    """D:\\x, D:/x and \\mnt\\d\\x as /mnt/d/x; other paths unchanged."""
    s = _slashes(c)
    found = F.coalesce(*[F.when(s.rlike(p), F.concat(F.lit("/mnt/"), F.lower(F.regexp_extract(s, p, 1)), F.lit("/"), F.regexp_extract(s, p, 2))) for p in (_MOUNT, _DRIVE)])
    return F.coalesce(found, c)


def to_windows(c: Column) -> Column:
    """/mnt/d/x (any slashes) as D:\\x; other paths unchanged."""
    s = _slashes(c)
    return F.when(s.rlike(_MOUNT), F.concat(F.upper(F.regexp_extract(s, _MOUNT, 1)), F.lit(":\\"), F.translate(F.regexp_extract(s, _MOUNT, 2), "/", "\\"))).otherwise(c)


def canonical_url(c: Column, local: list[str], default: str) -> Column:
    """The platform's default for any spelling of the local endpoint; others unchanged."""
    return F.when(F.regexp_replace(c, "/+$", "").isin(*[u.rstrip("/") for u in local]), F.lit(default)).otherwise(c)


def parse_default(c: Column) -> Column:
    """kind (null, bool, int, float, text) and value (as text) of a default that was typed in."""
    s = F.trim(c)
    whole = s.rlike(r"^[+-]?\d+(_\d+)*$")
    real = s.rlike(r"^[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?|(?i:inf|infinity|nan))$")
    kind = F.when(s.isNull() | (s == ""), "null").when(s.isin("True", "true", "False", "false"), "bool").when(whole, "int").when(real, "float").otherwise("text")
    value = F.when(kind == "null", F.lit(None)).when(kind == "bool", F.lower(s)).when(kind == "int", F.translate(s, "_+", "").try_cast("decimal(38,0)").cast("string")).when(kind == "float", F.translate(s, "_", "").try_cast("double").cast("string")).otherwise(s)
    return F.struct(kind.alias("kind"), value.alias("value"))
