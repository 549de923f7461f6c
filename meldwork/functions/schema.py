"""The shape of records, and expressions that look up source types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meldwork.functions import dims
from meldwork.functions.normalize import literal_map

EXPERIENCE = "struct<company:string,title:string,start:string,end:string,summary:string>"
EDUCATION = "struct<institution:string,degree:string,field:string,end_year:int>"
#: Columns of a record besides the entity key that merge() groups by; source_file, file_seq and row_seq say where it stood.
RECORD = {
    "source_file": "string", "source_type": "string", "file_seq": "bigint", "row_seq": "bigint", "candidate_id": "string",
    "full_name": "string", "headline": "string", "city": "string", "region": "string", "country": "string", "years_experience": "int",
    "linkedin": "string", "github": "string", "portfolio": "string",
    "emails": "array<string>", "phones": "array<string>", "skills": "array<string>", "other_links": "array<string>",
    "experience": f"array<{EXPERIENCE}>", "education": f"array<{EDUCATION}>", "raw_text": "string",
}


def as_records(df: DataFrame, *keys: str) -> DataFrame:
    """df with every column of a record: missing ones null, or empty for lists."""
    def column(name: str, kind: str) -> Column:
        value = F.col(name) if name in df.columns else F.lit(None)
        return (F.coalesce(value.cast(kind), F.array().cast(kind)) if kind.startswith("array") else value.cast(kind)).alias(name)

    return df.select(*keys, *[column(n, k) for n, k in RECORD.items()])


def priority(source_type: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map({k: str(v[0]) for k, v in dims.SOURCE_TYPES.items()}), source_type).cast("int"), F.lit(dims.DEFAULT_PRIORITY))


def weight(source_type: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map({k: str(v[1]) for k, v in dims.SOURCE_TYPES.items()}), source_type).cast("double"), F.lit(dims.DEFAULT_WEIGHT))


def display_name(source_type: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map({k: v[2] for k, v in dims.SOURCE_TYPES.items()}), source_type), F.lit(dims.DEFAULT_NAME))
