"""Written runs: one folder a run, which counts once its manifest stands there, committed by a rename.

The manifest tells the tables and the run's place in the order of commits: one more than the greatest of the manifests there, and the
time, which decides between runs that were committed at once.
"""

from __future__ import annotations

import json
import time
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "_manifest.json"


def _at(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The Hadoop path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _content(spark: SparkSession, path: str) -> dict | None:
    at, fs = _at(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def runs(spark: SparkSession, path: str) -> list[dict]:
    """The manifests of all whole runs under a path, in the order of their commits."""
    root, fs = _at(spark, path)
    if not fs.exists(root):
        return []
    found = [_content(spark, f"{s.getPath()}/{MANIFEST}") for s in fs.listStatus(root) if s.isDirectory()]
    return sorted((m for m in found if m), key=lambda m: (m["number"], m["committed"], m["run_id"]))


def write(tables: dict[str, DataFrame], path: str, run_id: str) -> None:
    """The tables under path/run_id, and then the manifest. A run of this id that was there stops counting first."""
    spark = next(iter(tables.values())).sparkSession
    home = f"{path.rstrip('/')}/{run_id}"
    at, fs = _at(spark, f"{home}/{MANIFEST}")
    fs.delete(at, False)
    part = uuid.uuid4().hex  # a write that was killed leaves a folder that no manifest names
    for name, table in tables.items():
        table.write.parquet(f"{home}/{part}/{name}")
    number = max((m["number"] for m in runs(spark, path)), default=0) + 1
    ready, _ = _at(spark, f"{home}/_{part}.json")
    out = fs.create(ready, True)
    out.write(bytearray(json.dumps({"run_id": run_id, "number": number, "committed": time.time(), "part": part, "tables": sorted(tables)}).encode()))
    out.close()
    if not fs.rename(ready, at):
        raise OSError(f"the run {run_id} couldn't be committed")


def read(spark: SparkSession, path: str, run_id: str = "latest") -> dict[str, DataFrame]:
    """The tables of a run; `latest` is the one committed last."""
    found = [m for m in runs(spark, path) if run_id in ("latest", m["run_id"])]
    if not found:
        raise FileNotFoundError(f"no whole run{'' if run_id == 'latest' else ' ' + run_id} under {path}")
    m = found[-1]
    return {t: spark.read.parquet(f"{path.rstrip('/')}/{m['run_id']}/{m['part']}/{t}") for t in m["tables"]}
