"""Intermediate tables in the folder that all executors of a cluster share.

A table written here replaces a cached or locally checkpointed DataFrame: it survives the loss of any executor,
and reading it again cuts the lineage. What is left of an application's tables goes when its JVM ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_leaving: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only where all runs on one machine (tests) may it be unset; then a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="lodestone-")
    return _own[context.applicationId]


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a scratch table."""
    folder = f"{shared_root(spark)}/lodestone-{spark.sparkContext.applicationId}"
    if folder not in _leaving:
        _leaving.add(folder)
        path, files = _file_system(spark, folder)
        files.mkdirs(path)
        files.deleteOnExit(path)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a shared Parquet table and return a DataFrame that reads it."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._scratch_path = path
    return found


#: Rows of ids (a few longs or short names each) that a join sends to every task at most.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(ids: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of ids, marked for broadcast if it has at most ``rows`` rows; a larger side is left to a shuffled join."""
    return F.broadcast(ids) if ids.count() <= rows else ids


def release(*tables: DataFrame) -> None:
    """Delete tables that ``keep`` returned and that nothing reads any more."""
    for df in tables:
        path, files = _file_system(df.sparkSession, df._scratch_path)
        files.delete(path, True)
