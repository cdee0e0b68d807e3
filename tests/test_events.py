import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lacuna.operators import events
from lacuna.sources import tables
from lacuna.streaming import events as stream

RUN = [
    dict(run_id="r", seq=0, step="exact", source="local", phase="started"),
    dict(run_id="r", seq=1, step="exact", source="local", phase="completed", status="no_result", flags=["b"], latency_ms=5.0),
    dict(run_id="r", seq=2, step="agent", source="model", phase="started", agent_iteration=0, cost_usd=0.25),
    dict(run_id="r", seq=4, step="agent", source="model", phase="failed", flags=["a", "b"], cost_usd=0.5),
    dict(run_id="r", seq=5, step="final_answer", source="system", phase="completed"),
    dict(run_id="s", seq=0, step="exact", source="local", phase="completed", result_count=2),
]


def log(spark, rows):
    names = [f.split()[0] for f in events.SCHEMA.replace("\n", " ").split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], events.SCHEMA)


def folded(spark, rows):
    return {r["run_id"]: r.asDict() for r in events.fold_runs(log(spark, rows)).collect()}


def test_fold(spark):
    r = folded(spark, RUN)["r"]
    assert r["order"] == ["exact:local", "agent:model", "final_answer:system"]
    assert r["flags"] == ["b", "a"] and r["total_cost_usd"] == 0.75 and r["agent_iterations"] == 1
    assert r["finished"] and r["last_seq"] == 5 and r["applied"] == 5 and r["failed_steps"] == 1
    step = events.fold_steps(log(spark, RUN)).where("run_id = 'r' and step = 'exact'").first()
    assert step["status"] == "no_result" and step["latency_ms"] == 5.0 and (step["started_at_seq"], step["completed_at_seq"]) == (0, 1)


def test_fold_ignores_order_and_copies(spark):
    mixed = RUN + RUN[1:3]
    random.Random(1).shuffle(mixed)
    assert {r["run_id"]: r.asDict() for r in events.fold_runs(events.first_wins(log(spark, mixed))).collect()} == folded(spark, RUN)


def test_replay(spark):
    assert events.after(log(spark, RUN), 2).count() == 2
    assert events.after(log(spark, RUN), None).count() == 6


def test_violations(spark):
    bad = [dict(run_id="x", seq=-1, step="exact", phase="started"), dict(run_id="x", seq=1, step="nope", phase="started"), dict(run_id="x", seq=2, step="exact", phase="completed", status="no_result", result_count=3), dict(run_id="x", seq=3, step="exact", phase="completed", status="odd")]
    assert [r["rule"] for r in events.violations(log(spark, bad + RUN)).orderBy("seq").collect()] == ["seq", "step", "count", "status"]


@pytest.fixture
def arrived(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(json.dumps(r) for r in RUN[:4]))
    (folder / "b.json").write_text("\n".join(json.dumps(r) for r in RUN[2:]))
    return str(folder)


def test_log_from_stream(spark, arrived, tmp_path):
    path = str(tmp_path / "log")
    stream.to_log(stream.read(spark, arrived, 1), path, str(tmp_path / "cp")).awaitTermination()
    held = spark.read.parquet(path)
    assert held.count() == len(RUN)
    assert {r["run_id"]: r["finished"] for r in events.fold_runs(held).collect()} == {"r": True, "s": False}


def test_stateful_fold(spark, arrived, tmp_path):
    query = stream.folded(stream.deduped(stream.read(spark, arrived, 1))).writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    last = spark.table("folded").groupBy("run_id").agg(F.max_by(F.struct("applied", "total_cost_usd", "finished"), "applied").alias("x")).select("run_id", "x.*").collect()
    assert {r["run_id"]: (r["applied"], r["total_cost_usd"], r["finished"]) for r in last} == {"r": (5, 0.75, True), "s": (1, 0.0, False)}


class State:
    """What the fold sees of a state store."""

    def __init__(self):
        self.value, self.hasTimedOut, self.timeout = None, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutTimestamp(self, ms):  # noqa: N802 - the store's name
        self.timeout = ms

    def getCurrentWatermarkMs(self):  # noqa: N802 - the store's name
        return 5_000


def test_state_is_bounded_and_removed():
    import pandas as pd

    state, order = State(), list(range(500))
    random.Random(2).shuffle(order)
    order = [x for i in range(0, 500, 20) for x in sorted(range(i, i + 20), key=order.index)]
    for i in range(0, 500, 20):
        rows = [{"seq": x, "cost_usd": 0.5, "agent_iteration": None, "step": "exact", "phase": "completed", "ts": None} for x in order[i : i + 20] + order[max(0, i - 5) : i]]
        out = list(stream._ending_fold(("r",), iter([pd.DataFrame(rows)]), state))
        assert len(state.value[-1]) <= 20 and not state.timeout
    assert out[0]["applied"][0] == 500 and out[0]["total_cost_usd"][0] == 250 and state.value[-2:] == (499, [])
    list(stream._ending_fold(("r",), iter([pd.DataFrame([{"ts": pd.Timestamp(9, unit="s", tz="UTC"), "seq": 502, "cost_usd": None, "agent_iteration": 3, "step": "final_answer", "phase": "completed"}])]), state))
    assert state.value[-1] == [502] and state.value[4] and state.timeout == 9_000 + stream.LINGER_MS
    state.hasTimedOut = True
    assert list(stream._ending_fold(("r",), iter([]), state)) == [] and state.value is None


def test_log_reads_only_the_buckets_of_a_batch(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [dict(run_id=f"run{i}", seq=k, step="exact", phase="completed") for i in range(30) for k in range(3)]
    frame = log(spark, rows)
    stream.append_once(frame, path)
    stream.append_once(frame.where("run_id = 'run7'"), path)
    assert spark.read.parquet(path).count() == 90
    one = stream.read_log(spark, path, "run7")
    assert [r["seq"] for r in one.collect()] == [0, 1, 2] and "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().executedPlan().toString()


def test_a_subscriber_that_raises_is_reported(spark):
    seen = []

    def broken(frame):
        raise ValueError("no")

    assert stream.notified(spark.range(2), [broken, lambda f: seen.append(f.count())]) == ["ValueError: no"] and seen == [2]


def test_finished_runs_leave_the_state(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k, (run, minute) in enumerate([("r", 0), ("r", 0), ("s", 90), ("t", 200)]):
        (folder / f"{k}.json").write_text(json.dumps(dict(run_id=run, seq=0, ts=f"2024-01-01T{minute // 60:02}:{minute % 60:02}:00Z", step="final_answer", phase="completed", cost_usd=1.0)))
        os.utime(folder / f"{k}.json", (1000 + k, 1000 + k))
    query = stream.folded(stream.read(spark, str(folder), 1), "10 minutes").writeStream.outputMode("update").format("memory").queryName("ended").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    rows = sorted((r["run_id"], r["applied"], r["finished"]) for r in spark.table("ended").collect())
    assert set(rows) == {("r", 1, True), ("s", 1, True), ("t", 1, True)}
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in map(json.loads, (p.json for p in query.recentProgress)) if p["stateOperators"]]
    assert kept[-1] <= 2


def test_dedupe_under_a_watermark(spark, arrived, tmp_path):
    late = stream.deduped(stream.read(spark, arrived), "10 minutes")
    query = late.writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("late").count() <= len(RUN) + 2


def test_relay_keeps_bad_payloads(spark):
    payloads = spark.createDataFrame([(json.dumps(RUN[0]),), ("not json",), ("{}",)], "value string")
    rows = stream.relayed(payloads).collect()
    assert [r["corrupt"] for r in rows] == [None, "not json", "{}"] and rows[0]["step"] == "exact"


def test_finalised(spark):
    runs = spark.createDataFrame([("r",), ("t",)], "run_id string")
    got = {r["run_id"]: (r["cost_usd"], r["finished"]) for r in tables.finalised(runs, log(spark, RUN)).collect()}
    assert got == {"r": (0.75, True), "t": (None, None)}


def test_tables(spark, tmp_path):
    path, rows = str(tmp_path / "t"), spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, v int")
    assert tables.insert_or_ignore(rows, path, "k", "v") == 2
    assert tables.insert_or_ignore(rows.withColumn("v", F.lit(9)), path, "k") == 0
    assert {r["k"]: r["v"] for r in spark.read.parquet(path).collect()} == {"a": 2, "b": 1}
    folder = str(tmp_path / "u")
    assert tables.upsert(rows.where("v = 1"), folder, "k") == 1
    assert tables.upsert(spark.createDataFrame([("a", 7)], "k string, v int"), folder, "k") == 2
    assert {r["k"]: r["v"] for r in spark.read.parquet(f"{folder}/v{tables.latest_version(spark, folder)}").collect()} == {"a": 7, "b": 1}
    ranked = tables.ranked_results(spark.sql("select 'r' as run_id, array('x', 'y') as evidence")).collect()
    assert [(r["rank"], r["evidence"]) for r in ranked] == [(1, "x"), (2, "y")]
