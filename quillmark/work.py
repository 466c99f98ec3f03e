"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder and driver and executors are one process, as in tests.
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints/quillmark"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, in one process, a local folder where it is unset; on a cluster that names none this is
    an error, since no machine would see what another wrote."""
    named, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not named and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named or LOCAL_CHECKPOINTS


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df to the shared folder, so that a lost executor costs no recomputation."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
