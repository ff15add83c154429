"""Cut points: tables written once to the folder that every executor can reach."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_FOLDER = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only a local session may do without the setting."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        configured = LOCAL_FOLDER
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    """An unused folder under the shared one; the session's end deletes it."""
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    handle = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    handle.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(handle)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Compute once, write as Parquet and read back, so that a lost executor costs no recomputation."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    read.stored_path = path
    return read


def release(df: DataFrame) -> None:
    """Delete a stored table that nothing still to be computed reads."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Collect the driver's garbage, on which Spark deletes the shuffle files of jobs that are done.

    Else they stay until the driver happens to be short of memory, beside those of the jobs that follow.
    Twice, as some are only let go of by what the first collection clears away; the last job's may need a later call.
    """
    gc.collect()
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()


def clear_stored(spark: SparkSession) -> None:
    """Delete what the session has stored so far. Results that read it must have been used up."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(folder):
        for status in system.listStatus(folder):
            system.delete(status.getPath(), True)
