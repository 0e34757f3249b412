"""Where lineage is cut: the folder that the cluster names for checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session may do without, as its one machine sees its own folders."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_dir()


@lru_cache(1)
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-scratch-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in that folder, to append to; it goes when the application ends."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(where)  # only what is there can be marked
    files.deleteOnExit(where)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed and kept in that folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_dir(df.sparkSession))
    return df.checkpoint()
