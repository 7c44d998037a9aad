"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The library's own setting for that folder, read where ``spark.checkpoint.dir`` is unset.
SETTING = "tessarine.staging.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A new path below the folder that driver and executors share.

    The session's ``spark.checkpoint.dir`` names that folder, or else its ``tessarine.staging.dir``, which can be set
    at run time. Where both are unset, a temporary folder serves if the driver runs all tasks itself (master
    ``local``); with executors of its own a session must name a folder, and this raises ValueError.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(SETTING, None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"set spark.checkpoint.dir, or {SETTING}, to a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/tessarine-{os.getpid()}"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def staged(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: what follows neither repeats
    its work nor depends on the executors that did it. Its shuffle files go at once, not when the driver next
    collects garbage. A table without a ``path`` of its own lives as long as the driver."""
    spark, own = df.sparkSession, path is None
    path = path or shared_dir(spark)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    if own:
        # what nothing has dropped by then goes with the driver
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table from ``staged``; nothing may read it afterwards."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
