"""Lineage cuts that survive a lost executor: checkpoints in the folder that the cluster shares."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written once; later stages read the files and never run the plan above again."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files and checkpoints of steps that nothing refers to any more.

    Spark does so when the driver's memory is next collected, which may be long after an iterative
    operator has filled the disks with what its earlier steps left.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
