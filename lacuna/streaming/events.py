"""The event log as a stream: source, relay of payloads, replay, dedupe and a running fold."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lacuna.operators import events


def read(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Events from JSON files as they arrive."""
    reader = spark.readStream.schema(events.SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(folder)


def relayed(payloads: DataFrame) -> DataFrame:
    """payloads (value: JSON text) to events; a payload that isn't an event keeps its text in `corrupt` and nothing else."""
    parsed = F.from_json("value", events.SCHEMA + ", corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"})
    flat = payloads.select(parsed.alias("e"), "value").select("e.*", "value")
    bad = F.col("corrupt").isNotNull() | F.col("run_id").isNull() | F.col("seq").isNull()
    return flat.withColumn("corrupt", F.when(bad, F.coalesce("corrupt", "value"))).drop("value")


def replayed(stream: DataFrame, backlog: DataFrame, last_seq: int | None) -> tuple[DataFrame, DataFrame]:
    """What a client gets: the backlog after what it has seen, and the stream under the same condition."""
    return events.after(backlog, last_seq), events.after(stream, last_seq)


def deduped(stream: DataFrame, late: str | None = None) -> DataFrame:
    """The first event of each (run_id, seq). With `late`, state is dropped once events are that much older than the newest."""
    if late:
        return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id", "seq"])
    return stream.dropDuplicates(["run_id", "seq"])


BUCKETS = 64


def bucket(run_id: Column) -> Column:
    """The folder of the log that a run's events lie in."""
    return F.pmod(F.xxhash64(run_id), F.lit(BUCKETS)).cast("int")


def append_once(batch: DataFrame, path: str) -> None:
    """Append a batch to the log, without events that the log or the batch already has.

    The log lies in buckets of runs: only those that the batch touches are read, and of them only its runs."""
    spark = batch.sparkSession
    new = events.first_wins(batch).withColumn("bucket", bucket(F.col("run_id")))
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.sc().hadoopConfiguration()).exists(place):
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
        held = spark.read.schema(new.schema).parquet(path).where(F.col("bucket").isin(touched) if touched else F.lit(False))
        held = held.join(new.select("run_id").distinct(), "run_id", "left_semi").select("run_id", "seq")
        new = new.join(held, ["run_id", "seq"], "left_anti")
    new.select(*batch.columns, "bucket").repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def read_log(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """The log, or one run of it in order: only its bucket is read."""
    log = spark.read.schema(events.SCHEMA + ", bucket int").parquet(path)
    if run_id is None:
        return log.drop("bucket")
    return log.where((F.col("bucket") == bucket(F.lit(run_id))) & (F.col("run_id") == run_id)).drop("bucket").orderBy("seq")


def to_log(stream: DataFrame, path: str, checkpoint: str, then: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Keep a log up to date, one micro-batch after another; what is left of the stream is processed and the query ends."""
    def each(batch: DataFrame, _: int) -> None:
        append_once(batch, path)
        if then:
            notified(batch, [then])

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def notified(frame: DataFrame, subscribers: list[Callable[[DataFrame], None]]) -> list[str]:
    """Hand a batch to each subscriber; what one raises is reported and doesn't keep it from the others."""
    faults = []
    for tell in subscribers:
        try:
            tell(frame)
        except Exception as error:  # noqa: BLE001 - a subscriber may raise anything
            faults.append(f"{type(error).__name__}: {error}")
    return faults


def relay(payloads: DataFrame, path: str, checkpoint: str, subscribers: list[Callable[[DataFrame], None]] | None = None) -> StreamingQuery:
    """Payloads of a channel (value: JSON text, from any streaming source) to the log and its subscribers; bad ones go to path + "-corrupt"."""
    def each(batch: DataFrame, _: int) -> None:
        rows = relayed(batch).persist()
        try:
            good = rows.where("corrupt is null").drop("corrupt")
            append_once(good, path)
            rows.where("corrupt is not null").select("corrupt").write.mode("append").text(f"{path}-corrupt")
            notified(good, subscribers or [])
        finally:
            rows.unpersist()

    return payloads.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_STATE = "last_seq bigint, applied bigint, cost double, iterations int, finished boolean, upto bigint, beyond array<bigint>"
FOLDED = "run_id string, last_seq bigint, applied bigint, total_cost_usd double, agent_iterations int, finished boolean"
LINGER_MS = 600_000


def _fold(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState, ending: bool = False) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    last, applied, cost, iterations, finished, upto, beyond = state.get if state.exists else (-1, 0, 0.0, 0, False, -1, [])
    held, newest = set(beyond), 0
    for batch in batches:
        for e in batch.sort_values("seq").itertuples():
            if e.seq <= upto or e.seq in held:
                continue
            held.add(int(e.seq))
            while upto + 1 in held:
                upto += 1
                held.remove(upto)
            last, applied = max(last, int(e.seq)), applied + 1
            cost += 0.0 if pd.isna(e.cost_usd) else float(e.cost_usd)
            iterations = max(iterations, 0 if pd.isna(e.agent_iteration) else int(e.agent_iteration) + 1)
            finished = finished or (e.step == "final_answer" and e.phase != "started")
            newest = max(newest, 0 if pd.isna(e.ts) else int(e.ts.timestamp() * 1000))
    state.update((last, applied, cost, iterations, bool(finished), upto, sorted(held)))
    if ending and finished:
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + LINGER_MS)
    yield pd.DataFrame({"run_id": [key[0]], "last_seq": [last], "applied": [applied], "total_cost_usd": [cost], "agent_iterations": [iterations], "finished": [bool(finished)]})


def _ending_fold(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    yield from _fold(key, batches, state, True)


def folded(stream: DataFrame, late: str | None = None) -> DataFrame:
    """The state of each run as its events come in; a repeated event changes nothing.

    A run's state is a few numbers: up to which number all events were seen, and those seen beyond a gap. With `late`, the
    most that events are behind the newest, a finished run lingers for LINGER_MS of event time, so that repeated events find
    it, and is then removed; without it the numbers of every run stay."""
    if late is None:
        return stream.groupBy("run_id").applyInPandasWithState(_fold, FOLDED, _STATE, "update", GroupStateTimeout.NoTimeout)
    return stream.withWatermark("ts", late).groupBy("run_id").applyInPandasWithState(_ending_fold, FOLDED, _STATE, "update", GroupStateTimeout.EventTimeTimeout)
