"""Incremental ingestion: new content rows are parsed as they arrive and merged into a versioned node store.

Beyond the batch operators: the same parse runs on a stream, and ``foreachBatch`` writes each micro-batch's nodes under its own batch number, so a replayed
batch overwrites itself and the store is the same however often a batch was tried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docweave.functions.text import html_text
from docweave.operators.structure import parse_documents


def content_stream(spark: SparkSession, path: str, per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema("id long, content_html string").option("maxFilesPerTrigger", per_batch).parquet(path)


def ingest(stream: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Nodes of each micro-batch into ``store/batch=N``; a batch that is tried again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        texts = batch.where("content_html is not null").select(F.col("id").cast("string").alias("id"), html_text(F.col("content_html")).alias("text"))
        parse_documents(texts, "id", "text").write.mode("overwrite").parquet(f"{store}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def events_by_window(stream: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Counts of event types per window with a watermark for late rows."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))
