"""Cutting lineage between rounds, and where tables that outlive a query go."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}


def _named(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Where none is named a local session (as in tests) takes a temporary one; a
    cluster, whose executors don't share such a folder, gets an error instead.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="siftline-")


def saver(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """checkpoint() into the shared folder."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(_named(spark))
    return lambda df: df.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, removed when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = f"{_named(spark).rstrip('/')}/siftline-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _FOLDERS[app])
    return f"{_FOLDERS[app]}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, rows: int = 0) -> DataFrame:
    """df written once as compressed Parquet in the shared folder, where given so many rows a file, and read back."""
    path = new_folder(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", rows).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: what it left stays for the cluster to clear
        pass
