"""Folders that driver and executors share, and the removal of what a failed run wrote."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that come to every task of among.
FEW = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, and only on one machine, a temporary one is made once a session."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("quarrymill.scratch", None)
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("quarrymill.scratch", named)
    return named.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str, **options) -> DataFrame:
    """df written once, for plans that read it several times: later readers read only the columns that they need."""
    path = fresh_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    df.sparkSession.sparkContext._jvm.System.gc()  # lets Spark delete the shuffle files of plans that nothing refers to any more
    return df.sparkSession.read.parquet(path)


def among(rows: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are in held, a table that is written already: up to FEW different keys come to every task, so that no row is
    exchanged before it is known to be wanted."""
    wanted = held.select(*keys).distinct()
    return rows.join(F.broadcast(wanted) if wanted.limit(FEW + 1).count() <= FEW else wanted, keys, "left_semi")


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder of any file system that Spark reaches; none if it isn't there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()) if fs.exists(where) else []


def removed(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
