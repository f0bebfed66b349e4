"""Lineage handling shared by the iterative operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only a session on one machine may leave it unset, and gets a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("utilmine.shared.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="utilmine-")
        spark.conf.set("utilmine.shared.dir", where)
    return where.rstrip("/") if "://" in where or not where.startswith("/") else "file://" + where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """End the lineage of an iteration's result with a checkpoint in the shared folder.

    Checkpoint files of results that nothing refers to any more are removed where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
