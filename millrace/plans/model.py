"""Templates, mappings, issues, rules: the data model."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import types as T

#: Names in issues, mappings and reports.
MATCH_SOURCES = ("exact", "fuzzy", "synonym", "ai", "manual", "unmapped")
SEVERITIES = ("error", "warning")
ISSUE_TYPES = ("missing_value", "bad_format", "extra_column", "ocr_failed", "pdf_parse_error", "unmapped_column", "duplicate_header")
NUMBER_TYPES = ("number", "numeric", "int", "float", "money", "price")
SIDECAR = ".template.json"

ISSUE = "struct<row: bigint, column: string, severity: string, type: string, message: string, value: string>"
MAPPING = "struct<template_col: string, source_col: string, match_source: string, confidence: double>"


@dataclass(frozen=True)
class TemplateColumn:
    name: str
    required: bool = False
    default: Any = None
    data_type: str | None = None
    order: int = 0


@dataclass(frozen=True)
class Template:
    columns: tuple[TemplateColumn, ...]
    path: str = ""
    sheet: str | None = None

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def required(self) -> list[str]:
        return [c.name for c in self.columns if c.required]

    def schema(self) -> T.StructType:
        """The target schema, with what the template says of a column as metadata."""
        kinds = {"int": T.LongType(), **{k: T.DoubleType() for k in NUMBER_TYPES if k != "int"}}
        return T.StructType([T.StructField(c.name, kinds.get((c.data_type or "").lower(), T.StringType()), True, {"required": c.required, "default": json.dumps(c.default), "data_type": c.data_type or "", "order": c.order}) for c in self.columns])

    def with_meta(self, meta: dict | None) -> Template:
        """Overlay of a sidecar's columns; names without an entry, or with an empty one, stay."""
        specs = (meta or {}).get("columns", {})
        return Template(
            tuple(TemplateColumn(c.name, bool(s.get("required", c.required)), s.get("default", c.default), s.get("type", c.data_type) or None, c.order) if (s := specs.get(c.name)) else c for c in self.columns), self.path, self.sheet
        )

    def save_meta(self, path: str | Path) -> Path:
        """Writes the sidecar: only columns of which something is said."""
        said = {c.name: {"required": c.required, "default": c.default, "type": c.data_type} for c in self.columns if c.required or c.default is not None or c.data_type}
        to = meta_path(path)
        to.write_text(json.dumps({"columns": said}, ensure_ascii=False, indent=2), encoding="utf-8")
        return to


def meta_path(path: str | Path) -> Path:
    return Path(f"{path}{SIDECAR}")


def load_meta(path: str | Path) -> dict | None:
    """The sidecar's content; None if it is missing or no JSON."""
    try:
        return json.loads(meta_path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return None


def template_of(names: list[str], path: str = "", sheet: str | None = None) -> Template:
    return Template(tuple(TemplateColumn(n or f"COL_{i + 1}", order=i) for i, n in enumerate(names)), path, sheet)


@dataclass(frozen=True)
class Mapping:
    template_col: str
    source_col: str | None
    match_source: str
    confidence: float


#: The fields of the three classes below are the keys of saved settings: fixed values.
@dataclass(frozen=True)
class CleanRules:
    trim: bool = True
    normalize_unicode: bool = True
    case: str = "none"
    output_date_format: str = "%d/%m/%Y"
    strip_currency: bool = True
    fill_defaults: bool = True


@dataclass
class AIConfig:
    enabled: bool = False
    api_key: str = ""
    model: str = ""
    base_url: str = ""
    timeout: float = 60.0
    temperature: float = 0.0
    max_tokens: int = 300
    aggressive: bool = False


@dataclass
class Settings:
    ai: AIConfig = field(default_factory=AIConfig)
    clean: CleanRules = field(default_factory=CleanRules)
    fuzzy_threshold: float = 60.0
    default_sheet: str | None = None
    default_skip_rows: int = 0

    def save(self, path: str | Path) -> None:
        from dataclasses import asdict

        Path(path).write_text(json.dumps(asdict(self), ensure_ascii=False, indent=2), encoding="utf-8")

    @classmethod
    def load(cls, path: str | Path) -> Settings:
        """All that was saved; defaults for what is missing or unreadable."""
        try:
            data = json.loads(Path(path).read_text(encoding="utf-8"))
        except (OSError, ValueError):
            return cls()
        known = lambda kind, d: kind(**{k: v for k, v in (d or {}).items() if k in kind.__dataclass_fields__})
        return cls(known(AIConfig, data.get("ai")), known(CleanRules, data.get("clean")), data.get("fuzzy_threshold", 60.0), data.get("default_sheet"), data.get("default_skip_rows", 0))
