"""Scans of files as they arrive: the same transforms under Structured Streaming.

Scans keep no state between files, so no watermark is needed; each micro-batch is written by its id, and a batch that runs
again after a failure overwrites its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def scan_stream(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, max_files: int = 1000) -> StreamingQuery:
    """Runs `transform` over artifacts of new Parquet files until none are left; results under out/batch=<id>."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
