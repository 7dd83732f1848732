"""The folder that the driver and all executors share, and tables written there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """As the cluster names it in ``spark.checkpoint.dir``. A temporary folder where that is unset
    and driver and executors are one process, as in tests; elsewhere an error, since
    executors would write to different disks."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one."""
    return f"{shared_dir(spark)}/countloom-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: cuts the lineage, and survives the
    loss of an executor. The table stays until ``clear``."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task gets of a table that ``spread`` deals out.
ROWS_A_TASK = 500_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Dealt by keys to as many tasks as ``rows``, the table's number of rows, asks for. What a task
    sorts then stays the same as the table grows; by bytes alone, tasks of rows that compress well get millions."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK)), *keys)


def clear(spark: SparkSession) -> None:
    """Deletes what this application has written to the shared folder. Call it when the
    results are written: DataFrames made before can't be read afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
