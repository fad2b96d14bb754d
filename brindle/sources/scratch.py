"""Tables on the storage that driver and executors share, for what several queries or branches read."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """This session's folder under spark.checkpoint.dir. Where that isn't set, a local one in local mode, and an
    error elsewhere. It goes when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not shared and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        root = f"{shared.rstrip('/')}/brindle-{app}-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="brindle-")
        _ROOTS[app] = root
        local = root.removeprefix("file://").removeprefix("file:")
        if local.startswith("/"):
            atexit.register(shutil.rmtree, local, ignore_errors=True)
    return _ROOTS[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str = "table") -> DataFrame:
    """Written once, read by all that use it; survives lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """The files of a table that `saved` wrote and nothing reads any more."""
    spark, root = df.sparkSession, scratch_root(df.sparkSession)
    for file in df.inputFiles():
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if folder.getParent().getName() == root.rstrip("/").rpartition("/")[2]:
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
            return
