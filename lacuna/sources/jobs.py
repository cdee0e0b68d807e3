"""Batch jobs in a folder: the table of jobs in versions, results by job, and the life of a job.

A job is scanned, then running, then done, cancelled, failed or interrupted; each of the last can run again. Changes of the
table are whole new versions, so readers never see half of one; results are appended and the last of a row counts.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators import batch
from lacuna.operators.batch import JobError
from lacuna.sources import tables
from lacuna.storage import checkpointed

JOB = "job_id string, path string, name string, headers array<string>, total_rows bigint, status string, query_column string, agent boolean, cap_usd double, created_at double, error string"
MOST_BLOCKS = 1_000
RESULT = "row_index bigint, status string, finished_at double, outcome string, job_id string"


class Jobs:
    """Jobs of a folder: jobs/v1, v2, ... and results/job_id=..."""

    def __init__(self, spark: SparkSession, folder: str, clock: Callable[[], float] = time.time) -> None:
        self.spark, self.folder, self.clock = spark, folder, clock

    def table(self) -> DataFrame:
        version = tables.latest_version(self.spark, f"{self.folder}/jobs")
        return self.spark.read.schema(JOB).parquet(f"{self.folder}/jobs/v{version}") if version else self.spark.createDataFrame([], JOB)

    def _put(self, **job: Any) -> dict[str, Any]:
        names = [f.split()[0] for f in JOB.split(", ")]
        tables.upsert(self.spark.createDataFrame([tuple(job.get(n) for n in names)], JOB), f"{self.folder}/jobs", "job_id")
        return job

    def find(self, job_id: str) -> dict[str, Any]:
        row = self.table().where(F.col("job_id") == job_id).first()
        if row is None:
            raise JobError(404, "no such job")
        return row.asDict()

    def add(self, path: str, name: str, headers: list[str], total_rows: int) -> str:
        job_id = uuid.uuid4().hex
        self._put(job_id=job_id, path=path, name=name, headers=headers, total_rows=total_rows, status="scanned", created_at=self.clock())
        return job_id

    def move(self, job_id: str, status: str, **more: Any) -> dict[str, Any]:
        """A job in its next status, if its life allows that."""
        job = self.find(job_id)
        if status not in batch.TRANSITIONS[job["status"]]:
            raise JobError(409, f"a job that is {job['status']} can't become {status}")
        return self._put(**{**job, **more, "status": status})

    def results(self, job_id: str | None = None) -> DataFrame:
        """(job_id, row_index, status, finished_at, outcome): all that was written, for a job only its folder is read."""
        path = f"{self.folder}/results"
        if not tables.exists(self.spark, path):
            return self.spark.createDataFrame([], RESULT)
        held = self.spark.read.schema(RESULT).parquet(path)
        return held if job_id is None else held.where(F.col("job_id") == job_id)

    def write(self, job_id: str, outcomes: DataFrame) -> None:
        """outcomes (row_index, status, outcome as JSON) of a job, as finished now."""
        rows = outcomes.select(F.col("row_index").cast("bigint").alias("row_index"), "status", F.lit(float(self.clock())).alias("finished_at"), "outcome", F.lit(job_id).alias("job_id"))
        rows.write.mode("append").partitionBy("job_id").parquet(f"{self.folder}/results")

    def begin(self, job_id: str, rows: DataFrame, column: str, rerun: str | None = None, agent: bool = False, cap_usd: float | None = None) -> DataFrame:
        """Set a job running; the rows that are left for it. Refused without the column, with results and no word on them, or with nothing left."""
        job = self.find(job_id)
        batch.start(job["status"], column if column in job["headers"] else None, 1)
        mine = rows.withColumn("job_id", F.lit(job_id))
        held = self.results(job_id).select("job_id", "row_index", "status", "finished_at")
        if rerun is None and held.limit(1).count():
            raise JobError(409, "the job has results; say which rows to run again: unresolved or all")
        left = batch.pending(mine, held, rerun or "none")
        batch.start(job["status"], column, left.limit(1).count())
        self.move(job_id, "running", query_column=column, agent=agent, cap_usd=cap_usd, error=None)
        return left.drop("job_id")

    def run(self, job_id: str, left: DataFrame, search: Callable[[DataFrame], DataFrame], block_rows: int = 20_000) -> str:
        """Search the rows that are left, block by block of row_index, and write the results of each; the status that the job ends with.

        What a block found stays when a later one fails or the job is cancelled, and status() counts it at once. Blocks are
        MOST_BLOCKS at most, larger ones where there are more rows. The work is a job group, so cancel() stops it on the executors; a job that was cancelled stays so."""
        context = self.spark.sparkContext
        context.setJobGroup(job_id, f"batch {job_id}", interruptOnCancel=True)
        try:
            rows = checkpointed(left)  # results that are written meanwhile don't change what is left
            size = max(block_rows, -(-rows.count() // MOST_BLOCKS))
            low, high = rows.agg(F.min("row_index"), F.max("row_index")).first()
            at = low
            while at is not None and at <= high and self.find(job_id)["status"] != "cancelled":
                block = rows.where(F.col("row_index") >= at)
                end = block.orderBy("row_index").select("row_index").limit(size).agg(F.max("row_index")).first()[0]
                if end is None:
                    break
                self.write(job_id, search(block.where(F.col("row_index") <= end)))
                at = end + 1
        except Exception as error:  # noqa: BLE001 - whatever went wrong belongs to the job
            if self.find(job_id)["status"] == "cancelled":
                return "cancelled"
            self.move(job_id, "failed", error=str(error).splitlines()[0] if str(error) else type(error).__name__)
            return "failed"
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
        if self.find(job_id)["status"] == "running":
            self.move(job_id, "done")
        return self.find(job_id)["status"]

    def cancel(self, job_id: str) -> None:
        if self.find(job_id)["status"] != "running":
            raise JobError(409, "the job isn't running")
        self.move(job_id, "cancelled")
        self.spark.sparkContext.cancelJobGroup(job_id)

    def interrupt(self) -> int:
        """After a restart: what was running is interrupted; how many jobs."""
        running = [r["job_id"] for r in self.table().where("status = 'running'").select("job_id").collect()]
        for job_id in running:
            self.move(job_id, "interrupted")
        return len(running)

    def status(self, job_id: str) -> dict[str, Any]:
        job = self.find(job_id)
        counts = {r["status"]: r["n"] for r in batch.status_counts(self.results(job_id).drop("outcome")).collect()}
        return {**job, "counts": counts, "finished_rows": sum(counts.values())}

    def listed(self, limit: int = 50, offset: int = 0) -> DataFrame:
        return batch.newest(batch.with_counts(self.table(), self.results().drop("outcome")), limit, offset)

    def delete(self, job_id: str) -> None:
        """A job with its results; not while it runs."""
        if self.find(job_id)["status"] == "running":
            raise JobError(409, "the job is running; cancel it first")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/results/job_id={job_id}")
        path.getFileSystem(self.spark._jsc.sc().hadoopConfiguration()).delete(path, True)
        tables.replace(self.table().where(F.col("job_id") != job_id), f"{self.folder}/jobs")

    def export(self, job_id: str, rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
        """rows (row_index, raw) of the upload with the columns of an export."""
        self.find(job_id)
        last = batch.latest(self.results(job_id))
        outcome = F.from_json("outcome", batch.OUTCOME).alias("outcome")
        return batch.export(rows.select("row_index", F.col("raw").alias("original")), last.select("row_index", outcome), columns)
