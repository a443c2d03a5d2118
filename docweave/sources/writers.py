"""Sinks (S13 version folders, S18, S21, S22)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_version(rows: DataFrame, folder: str, version: int, partition_by: list[str] | None = None) -> str:
    """A store's next version in a folder of its own: a folder that is being read is never overwritten."""
    path = f"{folder}/v{version:06d}"
    writer = rows.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def chunk_export(nodes: DataFrame, metadata: DataFrame, path: str, most: int = 2_000) -> None:
    """JSON lines ``{metadata, part, chunks}``: a document's nodes in lines of at most ``most``, so that no document has to fit a row."""
    head = metadata.dropDuplicates(["so_hieu"])
    rows = nodes.withColumn("part", F.floor(F.col("position") / most).cast("int"))
    fields = [c for c in nodes.columns if c != "so_hieu"]
    chunks = rows.groupBy("so_hieu", "part").agg(F.array_sort(F.collect_list(F.struct("position", *(c for c in fields if c != "position")))).alias("chunks"))
    chunks.join(head, "so_hieu", "left").select(F.struct("so_hieu", *(c for c in head.columns if c != "so_hieu")).alias("metadata"), "part", "chunks").write.json(path)


def with_sample(rows: DataFrame, path: str, key: str, n: int = 50) -> None:
    """The table, and its first ``n`` rows by key as JSON beside it."""
    rows.write.parquet(f"{path}/data")
    rows.orderBy(key).limit(n).coalesce(1).write.json(f"{path}/sample")
