"""Written intermediate tables, which end a plan's lineage in storage that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set, a temporary one on a single machine, and an error on a cluster."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="graphleaf-"))
    return context.getCheckpointDir()


_written: list[tuple[SparkSession, str]] = []


def written_folder(spark: SparkSession) -> str:
    """A new folder's name in the shared folder; what is written there goes when the driver's Python ends."""
    path = f"{shared_folder(spark)}/written-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_written)
    _written.append((spark, path))
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder."""
    path = written_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


TIDY_SECONDS = 10
_tidied = 0.0


def tidy(spark: SparkSession) -> None:
    """Let the driver's JVM collect what finished jobs have left, at most every ``TIDY_SECONDS``; their shuffle files stay on disk until then."""
    global _tidied
    if time.monotonic() - _tidied >= TIDY_SECONDS:
        spark.sparkContext._jvm.System.gc()
        _tidied = time.monotonic()


def numbered(rows: DataFrame, out: str = "pos") -> DataFrame:
    """Add ``out``: gapless from 0 in the order in which Spark reads ``rows`` (files in order, then lines).

    Rows are counted for each partition first; the running totals, a row a partition, are joined to the rows."""
    marked = rows.withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    sizes = marked.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(F.col("_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))  # as many rows as partitions
    placed = marked.withColumn("_part", part).join(F.broadcast(firsts), "_part")
    return placed.withColumn(out, F.col("_first") + F.col("_id") - F.shiftleft(F.col("_part"), 33)).drop("_id", "_part", "_first")


def _remove_written() -> None:
    for spark, path in _written:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may have ended first
            return
