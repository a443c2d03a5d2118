"""Session helpers: table access, lineage cuts in the shared folder, and sizes."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a side may have at most to be broadcast; with the row width checked below that is a few MB.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for this application's intermediate tables, in the one that the cluster names in ``spark.checkpoint.dir``.

    Without that setting a temporary folder is used where all tasks run in this process's machine (``local``); on a cluster it's an error, since each executor
    would write to a disk of its own and rows would be missing without notice.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; master is {master}")
        own = tempfile.mkdtemp(prefix="docweave-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = Path(own).as_uri()
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/docweave-{spark.sparkContext.applicationId}"


def settled(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and the rows outlive any executor.  ``clean`` deletes what was written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; for its end, when no result that reads them is needed any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it was counted to be small enough, else as it is (Spark then shuffles)."""
    rows = df.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def spread(scan: DataFrame) -> DataFrame:
    """A table scan for heavy work per row: a table of fewer splits than there are cores is dealt out over them first."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def tasks_for(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-rows // rows_per_task), 1)
