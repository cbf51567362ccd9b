"""Where streaming state and sinks go: a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where all runs on this machine, as in tests."""
    configured, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not configured and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return configured or tempfile.mkdtemp(prefix="lanternwatch-stream-")


def parts(spark: SparkSession) -> int:
    """Parts for rows that take longer to work on than to read: a fixed number, as Spark makes few of those that are small."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def settled(rows: DataFrame) -> DataFrame:
    """The same rows as a table in the shared folder.

    Whoever reads them several times then scans it, and does not plan and compute what made them anew.
    """
    path = f"{shared_folder(rows.sparkSession)}/settled-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
