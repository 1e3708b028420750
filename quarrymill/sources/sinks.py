"""Sinks: metric logs, vector collections, snapshots by run, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_metrics(metrics: DataFrame, path: str) -> None:
    """One JSON line a row, added to what is there."""
    metrics.write.mode("append").json(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Adds vectors by knowledge base; metadata values become texts."""
    out = vectors
    if "metadata" in vectors.columns:
        out = out.withColumn("metadata", F.transform_values("metadata", lambda _, v: v.cast("string")))
    out.write.mode("append").partitionBy("kb_id").parquet(path)


def commit_run(df: DataFrame, path: str, run_id: str | None = None) -> str:
    """Writes a run's rows under a run id, as one job: readers see all of them or none (see read_runs). A failed run leaves
    nothing that read_runs returns."""
    run_id = run_id or uuid.uuid4().hex
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)
    return run_id


def read_runs(spark: SparkSession, path: str, ledger: DataFrame) -> DataFrame:
    """The rows of the runs that the ledger (run_id, status) calls successful."""
    return spark.read.parquet(path).join(ledger.where("status = 'success'").select("run_id"), "run_id", "left_semi")


def replace_kbs(df: DataFrame, path: str) -> None:
    """Replaces the partitions of the knowledge bases in df and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kb_id").parquet(path)


def write_report(summary: DataFrame, raw: DataFrame, path: str) -> None:
    """A summary as CSV, and the rows behind it as JSON lines."""
    summary.coalesce(1).write.mode("overwrite").csv(f"{path}/summary", header=True)
    raw.write.mode("overwrite").json(f"{path}/raw")
