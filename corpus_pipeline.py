"""The corpus pipeline: five stages over documents, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meldwork.llm.common import aside, named, restored, written
from meldwork.llm.components import among, without
from meldwork.llm.decontaminate import matches
from meldwork.llm.line_dedup import dedup_lines
from meldwork.llm.near_dedup import near_classes
from meldwork.llm.packing import pack_documents, tokenizer_path
from meldwork.llm.quality import judged


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with the columns and, where there is one of that name, n_chars as the text's length."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(named(columns)) if "n_chars" in columns else docs.select(named(columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("_keep").select(named(docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; the documents stay."""
    return _counted(dedup_lines(docs), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id; 5-word shingles, 80 percent.

    Rows are judged by a key of their own: a null id is a document like others (after all ids, if its
    group has one), and of copies under one id one row stays.
    """
    rows, inner = aside(docs)
    doc = inner["doc_id"]
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "near-rows")
    classes = near_classes(rows, "_row", inner["text"]).select("id", "component")
    named_rows = rows.select(F.col("_row").alias("id"), F.struct(F.col(doc).isNull().alias("last"), doc, "_row").alias("rank"))
    kept = written(classes.join(named_rows, "id").groupBy("component").agg(F.min("rank").alias("rank")).select("rank._row"), "near-kept")
    gone = written(rows.select("_row").join(kept, "_row", "left_anti"), "near-gone")
    # The texts of the fewer ones, those that stay or those that go, are moved at most.
    left = without(rows, gone, ["_row"]) if gone.count() <= kept.count() else among(rows, kept, ["_row"])
    return restored(left, inner)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = written(matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("_found_id")).distinct(), "leaks")
    rows, inner = aside(docs)
    return restored(rows.join(found, F.col(inner["doc_id"]) == F.col("_found_id"), "left_anti"), inner)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in sequences of 2048 tokens."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: Hashing models, edit distances and a tokenizer are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
