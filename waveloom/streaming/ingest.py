"""Incremental ingest: new files are taken once, results replace those of the same key, running again changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def ingest_new(spark: SparkSession, source: str, schema: str, checkpoint: str, work: Callable[[DataFrame, int], None], fmt: str = "json") -> None:
    """Give every batch of files not seen before to ``work`` and stop when there are none left."""
    stream = spark.readStream.format(fmt).schema(schema).load(source)
    stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
