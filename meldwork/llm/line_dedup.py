"""Line dedup: levelled sorted runs of line hashes, compacted periodically.

Batches come in rising doc_id. Each batch's line keys are merge-anti-joined with the runs, and the
keys that are new become a run of their own; a level that holds `fanout` runs is merged into one run
of the next level. Runs are bucketed and sorted by hash, one file a bucket, so a batch is shuffled once to the buckets
and the runs, which grow with the corpus, are neither shuffled nor sorted again (for that, LineRuns sets
spark.sql.legacy.bucketedTableScan.outputOrdering in the session).

Defined cases: null or empty text is one empty line; a key shorter than `min_chars` never counts;
a line repeated within one document stays there; equal doc_ids count as one document; a null doc_id
is in no batch and keeps its lines; columns other than the id and the text pass through untouched, whatever
their names; columns named _n_lines or _n_dropped are replaced.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meldwork.llm.common import LOWER, SPACES, UPPER, aside, map_rows, restored, scratch, written

HASHES = ["h1", "h2"]
_TRIM = SPACES
_FOLD = str.maketrans(UPPER, LOWER)


def line_keys(text: Column, min_chars: int) -> Column:
    """The distinct keys of a text's lines that are long enough to count."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    keys = F.transform(lines, lambda x: F.btrim(F.translate(x, UPPER, LOWER), F.lit(SPACES)))
    return F.array_distinct(F.filter(keys, lambda k: F.length(k) >= min_chars))


def key_hashes(key: Column) -> list[Column]:
    """128 bits: the key's xxhash64 under two seeds."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2")]


class LineRuns:
    """First holder of every line key seen so far, in bucketed sorted runs over levels."""

    def __init__(self, spark: SparkSession, buckets: int = 16, fanout: int = 2) -> None:
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.levels: list[list[str]] = [[]]
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")

    def _run(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (rows.repartition(self.buckets, *HASHES).write.bucketBy(self.buckets, *HASHES).sortBy(*HASHES)
         .option("path", scratch(self.spark, name, name)).saveAsTable(name))
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def compact(self) -> None:
        """Merge every full level into one run of the next."""
        for i, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                if i + 1 == len(self.levels):
                    self.levels.append([])
                tables = [self.spark.table(name) for name in level]
                merged = tables[0]
                for t in tables[1:]:
                    merged = merged.unionByName(t)
                self.levels[i + 1].append(self._run(merged))
                level.clear()

    def add(self, lines: DataFrame, id_col: str) -> DataFrame:
        """Take one batch of (id, h1, h2), ids above all earlier ones; return its (id, h1) to drop."""
        self.compact()
        batch = lines.groupBy(*HASHES).agg(F.min(id_col).alias("first"), F.max(id_col).alias("last"))
        batch = written(batch.repartition(self.buckets, *HASHES), "line-batch")
        fresh, repeated = batch, batch.filter(F.col("first") < F.col("last")).select(*HASHES, "first")
        for run in self.runs():
            fresh = fresh.join(run.select(*HASHES), HASHES, "left_anti")
            old = run.withColumnRenamed("first", "held")
            repeated = repeated.unionByName(batch.join(old, HASHES).select(*HASHES, F.col("held").alias("first")))
        # A key that is in a run has its holder there; the batch's own first comes later, and the minimum takes care of it.
        repeated = repeated.groupBy(*HASHES).agg(F.min("first").alias("first"))
        self.levels[0].append(self._run(fresh.select(*HASHES, "first")))
        return written(lines.join(repeated, HASHES).filter(F.col("first") < F.col(id_col)).select(id_col, "h1"), "line-drops")


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4, buckets: int | None = None, fanout: int = 2) -> DataFrame:
    """(id, drops): for every document that loses lines, the hashes of the keys it loses."""
    spark = docs.sparkSession
    ids = docs.select(id_col)
    steps = [i / batches for i in range(1, batches)]
    cuts = sorted(set(ids.agg(F.percentile_approx(id_col, steps, 1000)).first()[0] or [])) if steps else []
    runs = LineRuns(spark, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), fanout)
    drops = None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = docs.filter((F.col(id_col) > low if low is not None else F.lit(True)) & (F.col(id_col) <= high if high is not None else F.col(id_col).isNotNull()))
        lines = part.select(id_col, F.explode(line_keys(F.col(text_col), min_chars)).alias("_key")).select(id_col, *key_hashes(F.col("_key")))
        found = runs.add(written(lines, "lines"), id_col)
        drops = found if drops is None else drops.unionByName(found)
    return drops.groupBy(id_col).agg(F.collect_set("h1").alias("_drops"))


def _split(text: str | None, drops: list[int] | None, min_chars: int) -> tuple[str, int, int]:
    lines = (text or "").split("\n")
    if not drops:
        return text or "", len(lines), 0
    gone, kept = {x & 0xFFFFFFFFFFFFFFFF for x in drops}, []
    for line in lines:
        key = line.translate(_FOLD).strip(_TRIM)
        if len(key) < min_chars or xxhash.xxh64_intdigest(key.encode(), 42) not in gone:
            kept.append(line)
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, **options: int) -> DataFrame:
    """docs with the text's repeated lines dropped, and _n_lines, _n_dropped (longs) behind."""
    docs, inner = aside(docs)
    id_col, text_col = inner[id_col], inner[text_col]
    columns = docs.columns
    drops = dropped_lines(docs, id_col, text_col, min_chars, **options).withColumnRenamed(id_col, "_drop_id")
    joined = docs.join(drops, F.col(id_col) == F.col("_drop_id"), "left").drop("_drop_id")

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [_split(t, d, min_chars) for t, d in zip(batch.column(text_col).to_pylist(), batch.column("_drops").to_pylist(), strict=True)]
        texts = pa.array([x[0] if t else t for x, t in zip(out, batch.column(text_col).to_pylist(), strict=True)], pa.string())
        arrays = [texts if c == text_col else batch.column(c) for c in columns]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())], names=[*columns, "_n_lines", "_n_dropped"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return restored(map_rows(joined.select(*columns, "_drops"), apply, f"{fields}, _n_lines long, _n_dropped long"), inner, "_n_lines", "_n_dropped")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), firsts AS (
  SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT l.doc_id, l.pos, l.line, coalesce(f.first < l.doc_id, false) AS gone FROM lines l LEFT JOIN firsts f ON l.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
