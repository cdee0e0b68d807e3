"""The streaming source with offsets and the numbering of events in state."""

import json
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lacuna.streaming import numbered, source

SCHEMA = "run_id string, event_id string, ts timestamp, step string, phase string"


def add(folder, name, rows, group=3):
    folder.mkdir(exist_ok=True)
    table = pa.table({
        "run_id": pa.array([r[0] for r in rows], pa.string()), "event_id": pa.array([r[1] for r in rows], pa.string()), "ts": pa.array([1_000_000 * i for i in range(len(rows))], pa.timestamp("us", "UTC")),
        "step": pa.array([r[2] for r in rows], pa.string()), "phase": pa.array(["completed"] * len(rows), pa.string()), "more": pa.array([1] * len(rows)),
    })
    pq.write_table(table, folder / f".{name}", row_group_size=group)
    (folder / f".{name}").rename(folder / name)


def ran(stream, place, then=None, timers=False):
    """Run what there is of a stream, one micro-batch after another, into a table of all rows with their batch."""
    def keep(rows, batch):
        if then:
            then(batch)
        rows.write.mode("append").parquet(f"{place}/out")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{place}/checkpoint").trigger(processingTime="0 seconds").start()
    try:
        if timers:  # they need batches without data, so all is never processed
            numbered.until_idle(query)
        else:
            query.processAllAvailable()
        return query.lastProgress
    finally:
        query.stop()


def test_source_without_gap_or_repeat(spark, tmp_path):
    events = tmp_path / "events"
    add(events, "a.parquet", [("r", f"a{i}", "exact") for i in range(10)])
    add(events, "b.parquet", [("r", f"b{i}", "exact") for i in range(4)])
    (events / "notes.txt").write_text("no events")
    failed = []

    def once(batch):
        if batch == 0 and not failed:
            failed.append(batch)
            raise ValueError("broken sink")

    stream = source.read(spark, str(events), SCHEMA, groupsPerTrigger="2", progress=str(tmp_path / "progress"))
    with pytest.raises(Exception, match="broken sink"):
        ran(stream, tmp_path, once)
    ran(stream, tmp_path, once)  # the batch comes again
    ids = sorted(r["event_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert failed and ids == sorted([f"a{i}" for i in range(10)] + [f"b{i}" for i in range(4)])
    add(events, "c.parquet", [("r", f"c{i}", "exact") for i in range(5)])
    ran(source.read(spark, str(events), SCHEMA, groupsPerTrigger="2", progress=str(tmp_path / "progress")), tmp_path)
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(ids + [f"c{i}" for i in range(5)])
    assert json.loads((tmp_path / "progress").read_text())["files"] >= 2
    reader = source.Reader(spark.createDataFrame([], SCHEMA).schema, {"path": str(events), "groupspertrigger": "3"})
    groups = reader.partitions({"files": 0, "groups": 0}, {"files": 2, "groups": 0})
    assert reader.latestOffset() == {"files": 3, "groups": 0}
    late = source.Reader(spark.createDataFrame([], SCHEMA).schema, {"path": str(events), "groupspertrigger": "3"})
    assert late.latestOffset() == {"files": 3, "groups": 0}  # not before where its query may stand
    late.at = late.initialOffset()
    assert [late.latestOffset() for _ in range(4)] == [{"files": 0, "groups": 3}, {"files": 2, "groups": 0}, {"files": 3, "groups": 0}, {"files": 3, "groups": 0}]
    assert [(g.path.rsplit("/", 1)[1], g.number) for g in groups] == [("a.parquet", i) for i in range(4)] + [("b.parquet", i) for i in range(2)]


def test_numbers_restart_and_removal(spark, tmp_path):
    events = tmp_path / "events"
    add(events, "a.parquet", [("r", "1", "exact"), ("s", "1", "exact"), ("r", "2", "bm25"), ("r", "1", "exact"), (None, "9", "exact"), ("r", None, "exact")])

    def stream():
        return numbered.numbered(source.read(spark, str(events), SCHEMA, groupsPerTrigger="1"), linger_ms=1)

    def seqs():
        return sorted((r["run_id"], r["seq"], r["event_id"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    ran(stream(), tmp_path, timers=True)
    assert seqs() == [("r", 0, "1"), ("r", 1, "2"), ("s", 0, "1")]
    add(events, "b.parquet", [("r", "2", "bm25"), ("r", "3", "final_answer"), ("s", "2", "exact")])
    ran(stream(), tmp_path, timers=True)  # from the checkpoint: numbers go on, repeats are known
    assert seqs() == [("r", 0, "1"), ("r", 1, "2"), ("r", 2, "3"), ("s", 0, "1"), ("s", 1, "2")]
    time.sleep(0.1)
    add(events, "c.parquet", [("t", "1", "exact")])
    ran(stream(), tmp_path, timers=True)  # the timer of r goes off here
    add(events, "d.parquet", [("r", "3", "exact"), ("s", "2", "exact")])
    ran(stream(), tmp_path, timers=True)
    assert seqs()[:4] == [("r", 0, "1"), ("r", 0, "3"), ("r", 1, "2"), ("r", 2, "3")]  # r was removed and begins anew; s is known
    assert [x for x in seqs() if x[0] == "s"] == [("s", 0, "1"), ("s", 1, "2")]


def test_state_is_bounded(spark, tmp_path):
    """Runs that have ended leave nothing: state doesn't follow the number of runs."""
    events, rows = tmp_path / "events", []
    for n in range(3):
        add(events, f"{n}.parquet", [(f"r{n}-{i}", str(e), "final_answer" if e else "exact") for i in range(20) for e in (0, 1)], 100)
        progress = ran(numbered.numbered(source.read(spark, str(events), SCHEMA), linger_ms=1), tmp_path, timers=True)
        rows.append(progress["stateOperators"][0]["numRowsTotal"])
    assert spark.read.parquet(f"{tmp_path}/out").count() == 120
    assert max(rows) <= 1.5 * rows[0], rows
