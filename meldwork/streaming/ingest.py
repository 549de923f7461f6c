"""Streaming ingest, an extension: new records are cleaned as they come and kept in a table by entity.

A micro-batch appends its normalized records, partitioned by batch; consolidation reads the table. A
batch that is run again overwrites its own partition, so a restart neither loses nor doubles records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meldwork.operators import clean


def start(records: DataFrame, path: str, checkpoint: str, region: str = "IN", countries: dict[str, str] | None = None) -> StreamingQuery:
    """Write every micro-batch of a stream of records to path, normalized and canonicalized."""

    def append(batch: DataFrame, number: int) -> None:
        ready = clean.canonicalize(clean.normalize(clean.parse(batch), region, countries))
        ready.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return records.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
