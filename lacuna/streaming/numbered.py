"""Numbers for the events of runs, in one streaming query with state of its own: seq given, repeats dropped, finished runs removed.

State of a run: the next number, the ids that were seen, each for `remember_ms`, and whether it has ended. A run that has
ended is removed by a timer after `linger_ms`, so that repeats of its last events still find it; an event that comes later begins the run anew.
Both count processing time, so state is bounded by the events of that time whatever the stream holds; for the timers such a query
goes on with micro-batches without data until it is stopped.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NUMBERED = "run_id string, event_id string, seq bigint, step string, phase string"


class Numbers(StatefulProcessor):
    def __init__(self, linger_ms: int, remember_ms: int) -> None:
        self.linger_ms, self.remember_ms = linger_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "seq bigint")
        self.seen = handle.getMapState("seen", "event_id string", "seq bigint", self.remember_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        seq, ended, out = (self.next.get()[0] if self.next.exists() else 0), False, []
        arrived = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        for e in arrived.itertuples():
            if self.seen.containsKey((e.event_id,)):
                continue
            self.seen.updateValue((e.event_id,), (seq,))
            out.append((key[0], e.event_id, seq, e.step, e.phase))
            seq += 1
            ended = ended or (e.step == "final_answer" and e.phase != "started")
        self.next.update((seq,))
        if ended:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.linger_ms)
        yield pd.DataFrame(out, columns=["run_id", "event_id", "seq", "step", "phase"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.next.clear()
        self.seen.clear()
        yield pd.DataFrame({"run_id": pd.Series([], dtype=str), "event_id": pd.Series([], dtype=str), "seq": pd.Series([], dtype="int64"), "step": pd.Series([], dtype=str), "phase": pd.Series([], dtype=str)})

    def close(self) -> None:
        return


def numbered(stream: DataFrame, linger_ms: int = 600_000, remember_ms: int = 3_600_000) -> DataFrame:
    """stream (run_id, event_id, ts, step, phase) to (run_id, event_id, seq, step, phase): in a micro-batch by ts, then id. Without either id an event has no place."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    placed = stream.select("run_id", "event_id", "ts", "step", "phase").where("run_id is not null and event_id is not null")
    return placed.groupBy("run_id").transformWithStateInPandas(Numbers(linger_ms, remember_ms), NUMBERED, "append", "ProcessingTime")


def until_idle(query: StreamingQuery, seconds: float = 0.2) -> None:
    """Wait for two micro-batches in a row that found no data, and stop; what the query failed with is raised. The first of them may be one that an earlier stop cut off."""
    try:
        while len(last := query.recentProgress[-2:]) < 2 or any(p["numInputRows"] for p in last) or last[0]["batchId"] == last[1]["batchId"]:
            if fault := query.exception():
                raise fault
            time.sleep(seconds)
    finally:
        query.stop()


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep a table of numbered events up to date. A micro-batch that is done again replaces its own rows."""
    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
