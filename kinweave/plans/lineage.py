"""Lineage cuts that survive the loss of executors."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    ``spark.checkpoint.dir`` is read from the session.  Only where it is unset
    and the driver runs all tasks itself (a local session) a temporary folder is
    set; on a cluster, where no other machine would see it, that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` as a checkpoint in the shared folder, its lineage dropped."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of files that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
