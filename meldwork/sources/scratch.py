"""Tables that a run writes for itself, in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only in local mode, where none is set, a folder of our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark, "_meldwork_run_folder", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = spark._meldwork_run_folder = "file://" + tempfile.mkdtemp(prefix="meldwork-run-")
    return found.rstrip("/")


#: What this process has written and not deleted.
_WRITTEN: list[str] = []


def written(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, str, dict]:
    """df written and read back, where it lies, and the metrics, which are taken while it is written."""
    spark, path, seen = df.sparkSession, f"{folder(df.sparkSession)}/{re.sub('[^a-z]+', '-', name.lower())}-{uuid.uuid4().hex}", Observation(name)
    _WRITTEN.append(path)
    (df.observe(seen, *[c.alias(k) for k, c in metrics.items()]) if metrics else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path, seen.get if metrics else {}


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in _WRITTEN:
        _WRITTEN.remove(path)


def purge(spark: SparkSession) -> None:
    """Delete every table that this process has written for itself. Call it when the results that rest on them are written."""
    for path in list(_WRITTEN):
        delete(spark, path)
