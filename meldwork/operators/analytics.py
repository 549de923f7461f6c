"""Questions asked of the result tables: rule search, counters, bands, stage metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def categories(log: DataFrame) -> DataFrame:
    return log.select("category").distinct()


def search(log: DataFrame, words: str = "", category: str | None = None) -> DataFrame:
    """Rules whose name, description or field holds the words, in any case, and that are of the category."""
    found = log
    if words:
        w = F.lower(F.lit(words))
        found = found.filter(F.contains(F.lower("rule"), w) | F.contains(F.lower("field"), w) | F.contains(F.lower("description"), w))
    return found.filter(F.col("category") == category) if category else found


def search_counts(log: DataFrame, words: str = "", category: str | None = None) -> DataFrame:
    return search(log, words, category).agg(F.count("*").alias("filtered")).crossJoin(log.agg(F.count("*").alias("total")))  # one row each


def rule_totals(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("total_rules"), F.count_if(F.col("rule") == "skill_canonicalize").alias("canonicalized_skills"))


def per_field(conflicts: DataFrame) -> DataFrame:
    return conflicts.groupBy("field").agg(F.count("*").alias("n"))


def win_rate(detected: Column, resolved: Column) -> Column:
    return F.when(detected > 0, resolved / detected * 100).otherwise(100.0)


def transform_ratio(changed: Column, total: Column) -> Column:
    return F.when(total > 0, F.coalesce(changed, F.lit(0)) / total).otherwise(0.0)


def confidence_band(score: Column) -> Column:
    return F.when(score > 0.8, "high").when(score > 0.5, "medium").otherwise("low")


def quality_band(score: Column) -> Column:
    return F.when(score >= 80, "good").when(score >= 50, "fair").otherwise("poor")


def counters(files: DataFrame, records: DataFrame, contested: DataFrame, errors: DataFrame, scored: DataFrame) -> DataFrame:
    """One row for the run: files, records, fields changed, duplicates, conflicts, errors, mean confidence and quality."""
    parts = [
        files.agg(F.count("*").alias("files_processed")),
        records.agg(F.count("*").alias("records_parsed"), F.coalesce(F.sum("_changed"), F.lit(0)).alias("fields_normalized"), F.coalesce(F.sum("_duplicates"), F.lit(0)).alias("duplicates_removed"), F.coalesce(F.sum("parsed_fields"), F.lit(0)).alias("fields_parsed")),
        contested.agg(F.count_if(F.col("rank") == 1).alias("conflicts_detected")).withColumn("conflicts_resolved", F.col("conflicts_detected")),
        errors.agg(F.count("*").alias("validation_errors")).withColumn("success", F.col("validation_errors") == 0),
        scored.agg(F.bround(F.avg("overall_confidence") * 100, 1).alias("average_confidence"), F.bround(F.avg("quality_score.overall_score"), 1).alias("quality_score")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)  # one row each
    return out
