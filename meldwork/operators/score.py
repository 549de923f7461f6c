"""Confidence per field, overall confidence, quality score and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meldwork.functions import dims
from meldwork.functions.schema import weight
from meldwork.functions.text import non_empty

_HAS = {
    "full_name": "full_name <> ''", "emails": "size(emails) > 0", "phones": "size(phones) > 0", "location": "city <> '' OR country <> ''", "headline": "headline <> ''",
    "skills": "size(skills) > 0", "experience": "size(experience) > 0", "education": "size(education) > 0", "links": "linkedin <> '' OR github <> ''",
}


def _valid() -> dict[str, Column]:
    return {
        "full_name": F.length("full_name") > 1, "emails": F.size("emails") > 0, "phones": F.size("phones") > 0,
        "location": non_empty(F.col("location.city")) | non_empty(F.col("location.country")), "headline": non_empty(F.col("headline")),
        "skills": F.size("skills") > 0, "experience": F.size("experience") > 0, "education": F.size("education") > 0,
        "links": non_empty(F.col("links.linkedin")) | non_empty(F.col("links.github")),
    }


def contributions() -> list[Column]:
    """For merge(): per field the records with a value and the best weight among their sources; and the entity's files."""
    aggs = []
    for field, test in _HAS.items():
        has = F.coalesce(F.expr(test), F.lit(False))
        aggs += [F.count_if(has).alias(f"_n_{field}"), F.max(F.when(has, weight(F.col("source_type")))).alias(f"_w_{field}")]
    return [*aggs, F.count_distinct("file_seq").alias("_files")]


def confidence(canonical: DataFrame) -> DataFrame:
    """A canonical table that was merged with contributions(), with field_confidences and overall_confidence: best weight times share of files, between one half and one."""
    fields, scores = [], []
    for field, ok in _valid().items():
        n = F.col(f"_n_{field}")
        share = F.greatest(F.lit(0.5), F.least(F.lit(1.0), n / F.greatest(F.col("_files"), F.lit(1))))
        score = F.bround(F.when(F.coalesce(ok, F.lit(False)), F.coalesce(F.col(f"_w_{field}"), F.lit(dims.DEFAULT_WEIGHT)) * share).otherwise(0.0), 4)
        scores.append(score)
        fields.append(F.struct(F.lit(field).alias("field"), score.alias("confidence"), F.col("_files").alias("source_count"), n.alias("sources_agreeing")))
    out = canonical.withColumn("field_confidences", F.array(*fields))
    total = F.aggregate("field_confidences", F.lit(0.0), lambda a, x: a + x["confidence"])
    return out.withColumn("overall_confidence", F.bround(total / len(fields), 4)).drop(*[f"_{x}_{f}" for f in _HAS for x in "nw"], "_files")


def unscored(canonical: DataFrame) -> DataFrame:
    """The columns of confidence() and quality() with nothing in them, for a run that goes on without scores."""
    kinds = {
        "field_confidences": "array<struct<field:string,confidence:double,source_count:bigint,sources_agreeing:bigint>>", "overall_confidence": "double",
        "quality_score": "struct<overall_score:double,missing_fields:array<string>,suggestions:array<string>,field_completeness:map<string,boolean>>",
    }
    out = canonical.drop(*[f"_{x}_{f}" for f in _HAS for x in "nw"], "_files")
    return out.withColumns({"field_confidences": F.array().cast(kinds["field_confidences"]), "overall_confidence": F.lit(0.0), "quality_score": F.lit(None).cast(kinds["quality_score"])})


def backfill(rows: DataFrame, scored: DataFrame, by: list[str]) -> DataFrame:
    """Provenance rows with the confidence of the field of the same name, where accepted; else 0."""
    known = scored.select(*by, F.explode("field_confidences").alias("f")).select(*by, "f.field", F.col("f.confidence").alias("_conf"))
    return rows.join(known, [*by, "field"], "left").withColumn("confidence", F.when(F.col("accepted"), F.coalesce("_conf", F.lit(0.0))).otherwise(0.0)).drop("_conf")


def quality(canonical: DataFrame) -> DataFrame:
    """canonical with quality_score: the earned share of the weights, what is missing, suggestions, completeness by label."""
    valid = _valid()
    tests = {k: valid[k] for k in dims.QUALITY if k in valid} | {"linkedin": non_empty(F.col("links.linkedin")), "github": non_empty(F.col("links.github"))}
    done = {k: F.coalesce(tests[k], F.lit(False)) for k in dims.QUALITY}
    total = sum(w for w, _, _ in dims.QUALITY.values())
    earned = sum(F.when(done[k], w).otherwise(0) for k, (w, _, _) in dims.QUALITY.items())
    return canonical.withColumn("quality_score", F.struct(
        F.bround(earned / total * 100, 1).alias("overall_score"),
        F.array_compact(F.array(*[F.when(~done[k], label) for k, (_, label, _) in dims.QUALITY.items()])).alias("missing_fields"),
        F.array_compact(F.array(*[F.when(~done[k], hint) for k, (_, _, hint) in dims.QUALITY.items()])).alias("suggestions"),
        F.map_from_arrays(F.array(*[F.lit(label) for _, label, _ in dims.QUALITY.values()]), F.array(*done.values())).alias("field_completeness"),
    ))


def validate(canonical: DataFrame, by: list[str]) -> DataFrame:
    """One row an error: empty name, e-mail without @, phone without +, confidence outside 0 to 1."""
    def error(field: str, text: Column, kind: str) -> Column:
        return F.struct(F.lit(field).alias("field"), text.alias("error"), F.lit(kind).alias("type"))

    found = F.concat(
        F.array_compact(F.array(
            F.when(~non_empty(F.coalesce("full_name", F.lit(""))), error("full_name", F.lit("Candidate name is empty"), "missing_value")),
            F.when(~F.col("overall_confidence").between(0, 1), error("overall_confidence", F.concat(F.lit("Confidence "), F.col("overall_confidence"), F.lit(" out of range [0, 1]")), "range_error")))),
        F.transform(F.filter("emails", lambda x: ~x.contains("@")), lambda x: error("emails", F.concat(F.lit("Invalid email format: "), x), "format_error")),
        F.transform(F.filter("phones", lambda x: ~x.startswith("+")), lambda x: error("phones", F.concat(F.lit("Phone not in E.164 format: "), x), "format_error")),
    )
    return canonical.select(*by, F.explode(found).alias("e")).select(*by, "e.*")


def schema_errors(canonical: DataFrame, by: list[str]) -> DataFrame:
    """One row a value that the canonical schema doesn't allow beyond its types: (by, field, error, type, input), field as a path, input cut to 100 characters."""
    def error(field: Column, text: str, kind: str, given: Column) -> Column:
        return F.struct(field.alias("field"), F.lit(text).alias("error"), F.lit(kind).alias("type"), F.substring(F.coalesce(given.cast("string"), F.lit("None")), 1, 100).alias("input"))

    def bounded(field: Column, x: Column, top: float) -> Column:
        low, high = error(field, "Input should be greater than or equal to 0", "greater_than_equal", x), error(field, f"Input should be less than or equal to {top:g}", "less_than_equal", x)
        return F.when(x < 0, low).when(x > top, high)

    def named(field: Column, x: Column) -> Column:
        return F.when(x.isNull(), error(field, "Input should be a valid string", "string_type", x))

    def at(*path: object) -> Column:
        return F.concat_ws(" → ", *[F.lit(p) if isinstance(p, str) else p for p in path])

    checks = [F.array(*[named(F.lit(c), F.col(c)) for c in ("candidate_id", "full_name") if c in canonical.columns])]
    if "skills" in canonical.columns:
        checks += [F.transform("skills", lambda s, i: named(at("skills", i.cast("string"), "name"), s["name"])), F.transform("skills", lambda s, i: bounded(at("skills", i.cast("string"), "confidence"), s["confidence"], 1))]
    if "field_confidences" in canonical.columns:
        checks += [F.transform("field_confidences", lambda f, i: bounded(at("field_confidences", i.cast("string"), "confidence"), f["confidence"], 1))]
    checks += [F.array(bounded(F.lit("overall_confidence"), F.col("overall_confidence"), 1))]
    return canonical.select(*by, F.explode(F.array_compact(F.concat(*checks))).alias("e")).select(*by, "e.*")
