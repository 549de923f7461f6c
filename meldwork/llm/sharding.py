"""Sharding: contiguous shards of near equal bytes from global prefix sums.

Rows are range-partitioned and sorted by (hash of the text, id), so equal texts lie together and
shards are well mixed. Each partition's byte and row totals, one row a partition, give every
partition's offsets; a running sum inside the partition gives each row's global byte offset; shards
are the ranges between equal targets. A cut that falls inside a group of equal texts moves to the
nearer end of the group, unless the group is larger than `group_slack` of a shard: balance wins then
and the group is split.

Defined cases: a null text has size 1 and counts as equal to the empty text in crc (0) only; equal
ids are ordered as they come, each gets a slot; an empty table gives no rows; columns other than the
id and the text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meldwork.llm.common import written


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", group_slack: float = 0.01) -> DataFrame:
    """(id, size, text_crc32, shard, slot, offset): every row's shard, place in it and global byte offset."""
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col), F.coalesce(F.octet_length(text) + F.lit(1), F.lit(1)).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"), F.xxhash64(text).alias("_h"), F.xxhash64(F.lit(7), text).alias("_g"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = written(rows.repartitionByRange(parts, "_h", "_g", id_col).withColumn("_part", F.spark_partition_id()), "shard-rows")
    # One row a partition: the prefix over them is bounded by the number of partitions.
    totals = rows.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows")).collect()
    before, n_bytes, n_rows = [], 0, 0
    for t in sorted(totals, key=lambda t: t["_part"]):
        before.append((t["_part"], n_bytes, n_rows))
        n_bytes, n_rows = n_bytes + t["_bytes"], n_rows + t["_rows"]
    starts = spark.createDataFrame(before or [(0, 0, 0)], "_part int, _bytes0 long, _rows0 long")
    inside = Window.partitionBy("_part").orderBy("_h", "_g", id_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumns({"_bytes": F.sum("size").over(inside), "_row": F.row_number().over(inside)}).join(F.broadcast(starts), "_part")
    placed = placed.withColumns({"offset": F.col("_bytes0") + F.col("_bytes") - F.col("size"), "_row": F.col("_rows0") + F.col("_row") - 1})
    placed = written(placed.select(id_col, "size", "text_crc32", "_h", "_g", "offset", "_row"), "shard-offsets")
    cuts = _cuts(placed, shards, n_bytes, group_slack)
    number = F.lit(0)
    for cut in cuts:
        number = number + (F.col("offset") >= cut).cast("int")
    sharded = placed.withColumn("shard", number)
    first = sharded.groupBy("shard").agg(F.min("_row").alias("_first"))  # one row a shard
    return sharded.join(F.broadcast(first), "shard").select(id_col, "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).cast("long").alias("slot"), "offset")


def _cuts(placed: DataFrame, shards: int, total: int, slack: float) -> list[int]:
    """Byte offsets at which shards 1, 2, ... begin."""
    targets = [total * i // shards for i in range(1, shards)]
    across = F.lit(False)
    for t in targets:
        across = across | ((F.col("offset") < t) & (F.col("offset") + F.col("size") > t)) | (F.col("offset") == t)
    keys = placed.filter(across).select("_h", "_g").distinct()  # at most two rows a cut
    spans = placed.join(F.broadcast(keys), ["_h", "_g"]).groupBy("_h", "_g").agg(F.min("offset").alias("low"), F.max(F.col("offset") + F.col("size")).alias("high")).collect()
    cuts = []
    for t in targets:
        span = next((s for s in spans if s["low"] < t < s["high"]), None)
        if span and span["high"] - span["low"] <= slack * total / shards:
            t = span["low"] if t - span["low"] <= span["high"] - t else span["high"]
        cuts.append(t)
    return cuts


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
