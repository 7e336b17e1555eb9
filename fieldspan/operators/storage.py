"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, from spark.checkpoint.dir.

    Where that is unset, a temporary folder is set, in local mode only: on a
    cluster a machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    if (found := context.getConf().get("spark.checkpoint.dir")) or (found := context._jsc.sc().getCheckpointDir().getOrElse(None)):
        return found
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="fieldspan-"))
    return context._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the driver ends; not yet there is its ``/<table>``."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4()}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed now and read from the shared folder from here on."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared one."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
