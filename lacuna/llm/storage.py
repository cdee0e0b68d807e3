"""Where operators keep intermediate tables: the shared checkpoint folder of the session.

Tables go to a folder of the application. Operators remove those that nothing reads any more; the rest, which results that
are still open may read, are removed when the process ends.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a folder of this process on a local master, as in tests, else an error."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = os.path.join(tempfile.gettempdir(), f"lacuna-{os.getpid()}")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder


def small_batches(spark: SparkSession, rows: int = 2_000, size: int = 8 << 20) -> None:
    """Let Arrow batches of this session hold at most so many rows and bytes, and stay so: texts are whole, both sides of a
    batch hold it in memory, and results are read after the operator returns."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, most)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(at, True)


def _remove_at_exit(spark: SparkSession, folder: str) -> None:
    if folder in _FOLDERS:
        return
    _FOLDERS.add(folder)

    def run() -> None:
        try:
            remove(spark, folder)
        except Exception:  # noqa: BLE001 - the JVM may be gone; files that stay harm nothing
            return

    atexit.register(run)


def keep(frame: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    spark = frame.sparkSession
    folder = f"{shared_folder(spark)}/lacuna-{spark.sparkContext.applicationId}"
    _remove_at_exit(spark, folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    table = spark.read.schema(frame.schema).parquet(path)
    table.__dict__["kept_at"] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables made by keep() that nothing will read again."""
    for table in tables:
        if path := table.__dict__.get("kept_at"):
            remove(table.sparkSession, path)
