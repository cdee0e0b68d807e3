"""Checkpoints in the shared folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a folder of this process on a local master, as in tests, else an error."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    folder = context.getConf().get("spark.checkpoint.dir") or (held.get() if held.isDefined() else None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = os.path.join(tempfile.gettempdir(), f"lacuna-{os.getpid()}")
    if not held.isDefined():
        context.setCheckpointDir(folder)
    return folder


def checkpointed(frame: DataFrame) -> DataFrame:
    shared_folder(frame.sparkSession)
    return frame.checkpoint()
