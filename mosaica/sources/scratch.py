"""Tables that a job writes for itself, in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Whether shuffle files go at the end of a query.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where none is set, a private one in local mode and an error on a cluster."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if there:
        return there
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"


#: Parquet's sizes for rows of many MB: what is buffered is measured from the first row on, not after 100, and a group of rows (which is read as one batch) ends beyond some MB.
WIDE = {"parquet.block.size": str(1 << 24), **{f"parquet.{x}.size.row.check.min": "1" for x in ("block", "page")}}


def stored(df: DataFrame, wide: bool = False) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: computed once, lineage cut, safe if executors go.

    The shuffle files that made it are removed as soon as it is written. With `wide`, for rows of images or diagrams, a task writes and reads few of them at a time.
    """
    spark, path = df.sparkSession, f"{_tables(df.sparkSession)}/{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**(WIDE if wide else {})).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes what stored() wrote and what was checkpointed for this application; for when its results are written down elsewhere."""
    folders = [_tables(spark), spark.sparkContext.getCheckpointDir()]
    for folder in filter(None, folders):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        # Spark gives each application a checkpoint folder of its own within the shared one
        for status in files.listStatus(path) if files.exists(path) else []:
            if folder == folders[0] or status.getPath().getName().startswith("rdd-"):
                files.delete(status.getPath(), True)
