"""Filings as a stream (an extension): each micro-batch of new files is chunked and merged into the index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def stream_texts(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """(file, text) of files as they arrive."""
    raw = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return raw.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("text"))


def into(stream: DataFrame, checkpoint: str, merge: Callable[[DataFrame], None]):
    """Start a query that hands every micro-batch to merge once the last is done; a batch that fails is handed over again, so merge must be idempotent, as an index update by content hash is."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: merge(df)).trigger(availableNow=True).start()


def into_index(stream: DataFrame, checkpoint: str, engine):
    """Start a query that brings every micro-batch of filings (file, text) into an engine's index; the filings of earlier batches stay, and a batch that is handed over again changes nothing. Coverage (Engine.build) says which filings are known."""

    def merge(batch: DataFrame) -> None:
        if not batch.isEmpty():
            engine.ingest(batch, partial=True)

    return into(stream, checkpoint, merge)
