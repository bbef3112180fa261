"""Cleaning of a frame to a template: one select of expressions, and an issue log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import excel_date, format_date, parse_date
from ..functions.numbers import parse_number, truncated
from ..functions.text import clean_text
from ..plans.model import ISSUE, NUMBER_TYPES, CleanRules, Mapping, Template


def clean_cell(raw: Column, data_type: str | None, rules: CleanRules, cell: Column | None = None) -> Column:
    """The cleaned value of a text: string, long or double; null if it can't be read as its type.

    cell: kind and number of a typed cell, null for a text. A number is a date by its days and itself as a number; a boolean
    is neither.
    """
    kind = (data_type or "").lower()
    if kind == "date":
        parsed = parse_date(raw)
        if cell is not None:
            parsed = F.when(cell["kind"] == "n", excel_date(cell["d"])).when(cell["kind"] == "b", None).otherwise(parsed)
        return format_date(parsed, rules.output_date_format)
    if kind in NUMBER_TYPES:
        number = parse_number(raw, rules.strip_currency)
        if cell is not None:
            number = F.when(cell["kind"] == "n", cell["d"]).when(cell["kind"] == "b", None).otherwise(number)
        return truncated(number) if kind == "int" else number
    return F.nullif(clean_text(raw, rules.trim, rules.normalize_unicode, rules.case), F.lit(""))


def issue(row: Column, column: str, severity: str, kind: str, message: str, value: Column | None = None) -> Column:
    value = F.lit(None).cast("string") if value is None else value.cast("string")
    return F.struct(row.cast("long").alias("row"), F.lit(column).alias("column"), F.lit(severity).alias("severity"), F.lit(kind).alias("type"), F.lit(message).alias("message"), value.alias("value"))


def apply_rules(df: DataFrame, template: Template, mappings: list[Mapping], rules: CleanRules | None = None, row_idx: str = "row_idx", keep: tuple[str, ...] = (), mapped: str | None = None, typed: str | None = None) -> DataFrame:
    """row_idx, a column for each template column in its order, `raw` (struct of source values), `issues`, and counts.

    A value that can't be read stays null here with its raw value beside it; `merged` makes the string the sink shows.
    An unmapped column is null and has no default. Cell issues come before default issues; the row of an issue is the
    index plus two, as in a sheet with one header line. keep: columns to take along. mapped: an array column with the
    names of the template columns that a row's file has; the others get no default. typed: a map column from template columns
    to the kind and number of a row's cells that are no text.
    """
    rules = rules or CleanRules()
    source = {m.template_col: m.source_col for m in mappings if m.source_col is not None and m.source_col in df.columns}
    mapped_cols = [t for t in template.columns if t.name in source]
    at = {t.name: i for i, t in enumerate(mapped_cols)}
    taken = [*keep, *(c for c in (mapped, typed) if c and c not in keep)]
    # three projections, so that a raw and a cleaned value are each computed once
    raw = df.select(*taken, F.col(row_idx).alias("row_idx"), *[F.col(f"`{source[t.name]}`").cast("string").alias(f"__raw{i}") for i, t in enumerate(mapped_cols)])
    done = raw.withColumns({f"__clean{i}": clean_cell(F.col(f"__raw{i}"), t.data_type, rules, F.try_element_at(typed, F.lit(t.name)) if typed else None) for i, t in enumerate(mapped_cols)})
    row = F.col("row_idx") + 2
    bad, filled, cleaned, defaults, outs = [], [], [], [], {}
    for i, t in enumerate(mapped_cols):
        c, clean, kind = F.col(f"__raw{i}"), F.col(f"__clean{i}"), (t.data_type or "").lower()
        typed = kind == "date" or kind in NUMBER_TYPES
        if typed:
            bad.append(F.when(c.isNotNull() & clean.isNull(), issue(row, t.name, "error", "bad_format", f"Not a valid {kind}", c)))
        cleaned.append(F.when(clean.isNotNull() & (clean.cast("string") != c), 1).otherwise(0))
        out = clean
        if rules.fill_defaults and t.default is not None:
            empty = c.isNull() if typed else clean.isNull()
            if mapped:
                empty = empty & F.array_contains(mapped, t.name)
            default = F.lit(t.default)
            filled.append(F.when(empty, issue(row, t.name, "warning", "missing_value", "Default filled in", default)))
            defaults.append(F.when(empty, 1).otherwise(0))
            out = F.when(empty, default.try_cast("long" if kind == "int" else "double") if kind in NUMBER_TYPES else default.cast("string")).otherwise(clean)
        outs[t.name] = out
    nothing = F.array().cast(f"array<{ISSUE}>")
    issues = F.array_compact(F.array(*bad, *filled)).cast(f"array<{ISSUE}>") if bad or filled else nothing
    add = lambda xs: sum(xs[1:], xs[0]) if xs else F.lit(0)
    schema = template.schema()
    columns = [(outs[t.name] if t.name in outs else F.lit(None).cast(schema[t.name].dataType)).alias(t.name) for t in template.columns]
    raws = F.struct(*[(F.col(f"__raw{at[t.name]}") if t.name in at else F.lit(None).cast("string")).alias(t.name) for t in template.columns])
    return done.select(*keep, "row_idx", *columns, raws.alias("raw"), issues.alias("issues"), add(cleaned).cast("long").alias("cleaned_cells"), add(defaults).cast("long").alias("filled_defaults"))


def merged(cleaned: DataFrame, template: Template, keep: tuple[str, ...] = ()) -> DataFrame:
    """Template columns as strings; where a value couldn't be read, the raw one."""
    def shown(n: str) -> Column:
        failed = F.exists("issues", lambda i: (i["column"] == n) & (i["type"] == "bad_format"))
        return F.coalesce(F.col(f"`{n}`").cast("string"), F.when(failed, F.col(f"raw.`{n}`"))).alias(n)

    return cleaned.select(*keep, "row_idx", *map(shown, template.names))


def issue_log(cleaned: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each issue."""
    return cleaned.select(*keep, F.inline("issues"))


def reorder(df: DataFrame, template: Template, mappings: list[Mapping]) -> DataFrame:
    """Exactly the template's columns in its order; unmapped ones null, other source columns dropped."""
    source = {m.template_col: m.source_col for m in mappings if m.source_col in df.columns}
    return df.select(*[F.col(f"`{source[n]}`").alias(n) if n in source else F.lit(None).cast("string").alias(n) for n in template.names])


def column_issues(source_cols: list[str], mappings: list[Mapping]) -> list[tuple]:
    """Issues of the mapping itself, with row 0: extra source columns, then unmapped template columns."""
    used = {m.source_col for m in mappings}
    extra = [(0, c, "warning", "extra_column", "Source column isn't in the template", None) for c in source_cols if c not in used]
    return extra + [(0, m.template_col, "error", "unmapped_column", "No source column found", None) for m in mappings if m.source_col is None]
