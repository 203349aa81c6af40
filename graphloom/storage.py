"""Scratch tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of this process's applications, each removed when the process ends.
_FOLDERS: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local one only where the session names none and runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "/tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(path)
    return path


def _removed(folder: str, context) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone; what is left is scratch
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration() if context._jsc else context._jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


def scratch_path(spark: SparkSession) -> str:
    """A new path in the application's own part of the scratch folder."""
    folder = f"{scratch_dir(spark).rstrip('/')}/scratch-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_removed, folder, spark.sparkContext)
    return f"{folder}/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here, and a lost executor costs no more than its tasks."""
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
