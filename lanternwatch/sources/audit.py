"""Audit rows: written by date, read with pruning, exported as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIT_SCHEMA = "id string, tenant_id string, user_id string, agent_id string, action string, severity string, resource string, details string, ts timestamp"


def write_audit(audit: DataFrame, path: str) -> None:
    """Appends, one folder a day. Errors are raised."""
    audit.withColumn("dt", F.to_date("ts")).write.partitionBy("dt").mode("append").parquet(path)


def read_audit(spark: SparkSession, path: str, since=None, until=None) -> DataFrame:
    """Whole days outside the range are pruned before files are opened."""
    rows = spark.read.schema(AUDIT_SCHEMA + ", dt date").parquet(path)
    if since is not None:
        rows = rows.where((F.col("dt") >= F.to_date(F.lit(since))) & (F.col("ts") >= F.lit(since)))
    if until is not None:
        rows = rows.where((F.col("dt") <= F.to_date(F.lit(until))) & (F.col("ts") <= F.lit(until)))
    return rows.drop("dt")


def export_audit_csv(audit: DataFrame, path: str) -> None:
    """Columns id, timestamp, action, severity, resource, details; quotes doubled."""
    shown = audit.select("id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), "action", "severity", "resource", "details")
    shown.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
