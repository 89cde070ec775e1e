"""The folder that driver and executors share, and checkpoints in it."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder stands in for it on a local master alone."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (context.master.startswith("local") and not context.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir is unset, and driver and executors need a folder that they share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialises `df` in the shared folder and cuts its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read again, for tables that pass through many rounds of joins.

    A checkpoint keeps the estimate of its plan's size, which every join multiplies, so that it grows without end over rounds;
    files have the size that they have.
    """
    folder = f"{checkpoint_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def release(df: DataFrame) -> None:
    """Deletes the files of a checkpointed or stored `df` that nothing reads any more; any other frame is left alone."""
    folders = {os.path.dirname(f) for f in df.inputFiles()}
    if len(folders) == 1 and os.path.basename(next(iter(folders))).startswith("stored-"):
        delete(df.sparkSession, folders.pop())
        return
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRDD":
        found = plan.rdd().getCheckpointFile()
        if found.isDefined():
            delete(df.sparkSession, found.get())


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
