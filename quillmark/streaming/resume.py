"""Resumable runs: rows that arrive as files are worked off once, in bounded batches, with an exactly-once sink.

The query's checkpoint knows which files are done and each batch is written to a folder of its own, which a repeated
batch replaces; maxFilesPerTrigger bounds what is in flight, availableNow ends the run when nothing is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def process_new(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files_at_once: int = 24) -> StreamingQuery:
    """Start a run over the JSON files under source that earlier runs haven't seen."""

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(source)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def results(spark: SparkSession, sink: str) -> DataFrame:
    """All batches' rows, with seq, so that the last of a key may win."""
    return spark.read.parquet(sink).withColumnRenamed("batch", "seq")
