"""Bundles as they arrive: an extension, since the batch audit is the contract.

A directory of newline-delimited JSON bundles (bundle_id and a text column for each file) is read as a stream; the
stateless rules of a bundle run on every micro-batch, which holds whole bundles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from folioscan.operators import artifacts

SCHEMA = "bundle_id string, " + ", ".join(f"{c} string" for c in (*artifacts.FILES, "html"))


def read_bundles(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """The stream of bundles below path."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)


def audit_to(bundles: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append every batch's messages to Parquet below out, one directory per batch, so that a repeated batch replaces
    its own output. Processes what is there and ends."""

    def write(batch: DataFrame, batch_id: int) -> None:
        artifacts.audit(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return bundles.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
