"""The projection language: paths such as name, location.country, emails[0] and skills[].name, compiled to columns.

A path is parsed once on the driver against the schema; a step that can't be taken gives null, as an
index out of range does. `[]` maps over an array, one level and one field deep.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INDEXED = re.compile(r"(\w+)\[(\d+)\]", re.ASCII)


@dataclass(frozen=True)
class Field:
    path: str
    source: str | None = None
    type: str = "string"  # declared only; never applied
    required: bool = False
    normalize: str | None = None  # declared only; never applied


@dataclass(frozen=True)
class OutputConfig:
    fields: list[Field] = field(default_factory=list)
    include_confidence: bool = True
    include_provenance: bool = True
    include_analytics: bool = True  # without effect
    on_missing: str = "null"

    @classmethod
    def parse(cls, given: dict | None) -> OutputConfig:
        """The config that a dict states; the default where it is empty or invalid."""
        try:
            fields = [Field(f["path"], f.get("from", f.get("source")), f.get("type", "string"), bool(f.get("required", False)), f.get("normalize")) for f in (given or {}).get("fields", [])]
            flags = {k: given[k] for k in ("include_confidence", "include_provenance", "include_analytics", "on_missing") if k in (given or {})}
            if flags.get("on_missing", "null") not in ("null", "omit", "error"):
                return cls()
            return cls(fields, **flags)
        except (AttributeError, KeyError, TypeError):
            return cls()


DEFAULT_CONFIG = {"fields": [], "include_confidence": True, "include_provenance": True, "include_analytics": True, "on_missing": "null"}
EXAMPLE_CONFIG = DEFAULT_CONFIG | {"fields": [{"path": "full_name"}, {"path": "primary_email", "from": "emails[0]"}, {"path": "phone", "from": "phones[0]"}, {"path": "skills", "from": "skills[].name"}]}


def compile_path(path: str, schema: T.StructType) -> Column:
    """The column that a path stands for."""
    null = F.lit(None).cast("string")
    if "[]." in path:
        head, name = path.split("[].", 1)
        column, kind = _walk(head, schema)
        if column is None or not isinstance(kind, T.ArrayType):
            return null
        inner = kind.elementType
        if isinstance(inner, T.StructType) and name in inner.fieldNames():
            return F.transform(column, lambda x: x[name])
        return F.transform(column, lambda x: F.lit(None).cast("string"))
    column, _ = _walk(path, schema)
    return null if column is None else column


def _walk(path: str, schema: T.StructType) -> tuple[Column | None, T.DataType | None]:
    column, kind = None, schema
    for step in path.split("."):
        m = _INDEXED.fullmatch(step)
        name = m[1] if m else step
        if isinstance(kind, T.MapType) and not m:
            column, kind = F.try_element_at(column, F.lit(name)), kind.valueType
            continue
        if not isinstance(kind, T.StructType) or name not in kind.fieldNames():
            return None, None
        column = F.col(f"`{name}`") if column is None else column[name]
        kind = kind[name].dataType
        if m:
            if not isinstance(kind, T.ArrayType):
                return None, None
            column, kind = F.get(column, F.lit(int(m[2]))), kind.elementType
    return column, kind


def project(canonical: DataFrame, by: list[str], config: OutputConfig) -> DataFrame:
    """by and the projected columns; with on_missing=omit a struct can't drop keys: use project_json()."""
    extra = (["overall_confidence"] if config.include_confidence and "overall_confidence" in canonical.columns else []) + (["provenance"] if config.include_provenance and "provenance" in canonical.columns else [])
    if not config.fields:
        hidden = {"field_confidences", "quality_score", "n_records", "overall_confidence", "provenance", *by}
        return canonical.select(*by, *[c for c in canonical.columns if c not in hidden], *extra)
    named = {f.path: compile_path(f.source or f.path, canonical.schema) for f in config.fields}
    return canonical.select(*by, *[c.alias(n) for n, c in named.items()], *[c for c in extra if c not in named])


def project_json(canonical: DataFrame, by: list[str], config: OutputConfig) -> DataFrame:
    """by and json: the projected object, with keys left out where on_missing is omit. `[]` and '' aren't missing."""
    flat = project(canonical, by, config)
    omit = config.on_missing == "omit"
    own = {f.path for f in config.fields}

    def part(name: str) -> Column:
        value = F.col(f"`{name}`")
        text = F.concat(F.lit(f'"{name}":'), F.coalesce(F.to_json(value.cast("variant")) if isinstance(flat.schema[name].dataType, T.AtomicType) else F.to_json(value, {"ignoreNullFields": "false"}), F.lit("null")))
        return F.when(value.isNotNull(), text) if omit and name in own else text

    parts = [part(n) for n in flat.columns if n not in by]
    return flat.select(*by, F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("json"))


def missing_errors(canonical: DataFrame, by: list[str], config: OutputConfig) -> DataFrame:
    """With on_missing=error, a row for every required field that is null."""
    wanted = [f for f in config.fields if f.required] if config.on_missing == "error" else []
    checks = [F.when(compile_path(f.source or f.path, canonical.schema).isNull(), F.struct(F.lit(f.path).alias("field"), F.lit(f"Required field '{f.path}' is missing").alias("error"), F.lit(f.source or f.path).alias("source_path"))) for f in wanted]
    found = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<struct<field:string,error:string,source_path:string>>")
    return canonical.select(*by, F.explode(found).alias("e")).select(*by, "e.*")
