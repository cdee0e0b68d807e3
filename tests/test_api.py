import json

import pytest

from pyspark.sql import functions as F

from lacuna import api
from lacuna.config import HAN, ConfigError
from lacuna.operators import agent, batch, corpus, exact, hybrid, service
from lacuna.operators.readings import enumerate_readings
from lacuna.sources import jobs, xlsx

NIGHT = "細草微風岸，危檣獨夜舟。星垂平野闊，月湧大江流。"


@pytest.fixture(scope="module")
def engine(spark):
    raw = spark.createDataFrame([("旅夜書懷", "杜甫", [NIGHT], "1", "tang", "a")], "title string, author string, paragraphs array<string>, upstream_id string, dataset string, file string")
    authors = corpus.authors_of(spark.createDataFrame([("杜甫", "唐", None, "a")], "name string, dynasty string, bio string, file string"))
    return api.Engine(spark, corpus.build(raw, authors, HAN), scorer=hybrid.lexical_scorer)


def test_search(engine):
    found = engine.search("星垂平野闊\n辛亥年秋月書").outcomes.first()
    assert found["status"] == "has_result" and found["kind"] == "full"
    for bad in ("", "天" * 2001):
        with pytest.raises(api.RequestError):
            engine.search(bad)
    assert engine.config({"top_k": 5})["top_k"] == 5
    with pytest.raises(ConfigError):
        engine.search("天地", {"odd": 1})
    health = engine.health({"model_id": "m"})
    assert health["corpus"] and not health["vectors"] and "meta" in health["model"]


def test_tools(engine):
    exact = agent.run_tool(engine.exact_tool(), {"query": "危檣獨夜舟"})
    assert exact.status == "has_result" and exact.rows[0]["score"] == 5
    assert agent.run_tool(engine.exact_tool(), {"query": "龘龘龘龘龘"}).status == "no_result"
    assert agent.run_tool(engine.semantic_tool(), {"query": "大江星垂龘靐齉爩麤龗灪吁圳丼彘"}).status == "low_confidence"
    assert agent.run_tool(agent.ask_model_tool(lambda q: " it is "), {"query": "天地"}).rows[0]["content"] == "it is"
    assert agent.run_tool(agent.ask_model_tool(None), {"query": "天地"}).status == "unavailable"


def test_batch(spark, engine, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text("\n".join([json.dumps({"id": 1, "poem": "星垂平野闊"}), "oops", json.dumps({"id": 2, "poem": " "}), json.dumps({"id": 3, "poem": "龘龘龘龘"})]) + "\n")
    with pytest.raises(api.RequestError, match="line 2"):
        api.batch_rows(spark, str(path))
    path.write_text(path.read_text().replace("oops\n", ""))
    profiles, suggestion = api.batch_scan(spark, str(path))
    assert suggestion.first()["suggested"] == "poem" and profiles.count() == 2
    got = {r["row_index"]: r["status"] for r in api.batch_search(engine, api.batch_rows(spark, str(path)), "poem").collect()}
    assert got == {0: "has_result", 1: "skipped", 2: "no_result"}
    assert api.batch_estimate(spark, 100, True) == {"rows": 100, "agent_rows": 30, "seconds": 356, "time": {"value": 5.9, "unit": "minute"}}
    assert len(api.batch_columns()) == 36 and api.corpus_rules()["least_han"] == 4


def test_tools_of_an_engine(engine):
    tools = engine.tools()
    assert list(tools) == ["search_local_exact", "search_local_semantic", "search_web", "ask_model"]
    assert [t["name"] for t in agent.offered(tools)] == ["search_local_exact", "search_local_semantic"]
    found = agent.run_tool(tools["search_local_semantic"], {"query": "星垂平野闊，月湧大江"})
    assert "星垂平野闊" in found.rows[0]["content"]


def test_stored_index(spark, engine, tmp_path):
    over = engine.indexed(str(tmp_path / "index"))
    plain, stored = engine.search("星垂平野闊月湧\n大江流").outcomes.first(), over.search("星垂平野闊月湧\n大江流").outcomes.first()
    assert plain.asDict(True) == stored.asDict(True)
    assert engine.indexed(str(tmp_path / "index")).index.stats.first()["total_docs"] == 1
    asked = exact.sweep(enumerate_readings(spark.createDataFrame([(1, "星垂平野闊")], "query_id int, text string"), HAN, most=1), HAN)
    plan = exact.hits(asked, None, HAN, index=over.index)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_results_are_released(spark, engine):
    spark.catalog.clearCache()
    result = engine.search("星垂平野闊")
    assert result.outcomes.first()["status"] == "has_result" and result.held
    result.release()
    assert not spark._jsparkSession.sharedState().cacheManager().lookupCachedData(result.held[0]._jdf).isDefined()


def test_a_source_that_fails_is_reported(spark, engine):
    points = spark.range(3).select("id", F.raise_error(F.lit("gone")).cast("array<float>").alias("vector"), F.lit("w").alias("work_id")).withColumnRenamed("id", "point_id")
    broken = api.replace(engine, points=points)
    asked = spark.createDataFrame([(0, [1.0])], "query_id bigint, vector array<double>")
    got = {r["source"]: r for r in broken.search("天地日月龘靐", query_vectors=asked, measured=True).reports.collect()}
    assert got["vector"]["status"] == "error" and got["vector"]["error_code"] == "internal" and got["vector"]["latency_ms"] > 0
    assert got["bm25"]["status"] in ("has_result", "no_result") and got["bm25"]["latency_ms"] > 0 and got["bm25"]["error_code"] is None


def test_jobs(spark, engine, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text("\n".join(json.dumps({"id": i, "poem": p}) for i, p in enumerate(["星垂平野闊", " ", "龘龘龘龘"])) + "\n")
    now = [0.0]

    def clock():
        now[0] += 1
        return now[0]

    store = jobs.Jobs(spark, str(tmp_path / "jobs"), clock)
    job = api.batch_upload(store, str(path), "mine")
    assert job["headers"] == ["id", "poem"] and job["total_rows"] == 3 and job["suggested"] == "poem"
    key = job["job_id"]

    def refused(code, run):
        with pytest.raises(batch.JobError) as fault:
            run()
        assert fault.value.code == code

    refused(404, lambda: api.batch_status(store, "none"))
    refused(400, lambda: api.batch_start(engine, store, key, "nope"))
    refused(409, lambda: api.batch_cancel(store, key))
    done = api.batch_start(engine, store, key, "poem")
    assert done["status"] == "done" and done["pending_rows"] == 3
    assert api.batch_status(store, key)["counts"] == {"has_result": 1, "skipped": 1, "no_result": 1}
    refused(409, lambda: api.batch_start(engine, store, key, "poem"))
    again = api.batch_start(engine, store, key, "poem", "unresolved")
    assert again["pending_rows"] == 1 and api.batch_status(store, key)["finished_rows"] == 3
    rows = {r["row_index"]: r for r in api.batch_export(store, key, ["title"], str(tmp_path / "out")).collect()}
    assert rows[0]["han_title"] == "旅夜書懷" and rows[0]["han_status"] == "has_result" and rows[1]["han_title"] is None
    assert spark.read.text(str(tmp_path / "out")).count() == 3
    other = store.add("x", "other", ["a"], 1)
    assert [r["job_id"] for r in api.batch_list(store).collect()] == [other, key]
    store.move(other, "running")
    refused(409, lambda: api.batch_delete(store, other))
    refused(409, lambda: store.move(other, "scanned"))
    assert store.interrupt() == 1 and store.find(other)["status"] == "interrupted"
    store.move(other, "running")
    api.batch_cancel(store, other)
    assert store.find(other)["status"] == "cancelled"
    api.batch_delete(store, key)
    refused(404, lambda: api.batch_status(store, key))
    assert store.results().count() == 0

    def broken(left):
        raise ValueError("broken search")

    store.move(other, "running")
    assert store.run(other, spark.range(1).withColumnRenamed("id", "row_index"), broken) == "failed" and store.find(other)["error"] == "broken search"


def test_blocks_of_a_job_are_kept(spark, tmp_path):
    store = jobs.Jobs(spark, str(tmp_path / "jobs"))
    key = store.add("x", "mine", ["poem"], 7)
    rows = spark.createDataFrame([(i, None, "x") for i in (0, 1, 2, 5, 6, 9, 12)], "row_index bigint, parse_error string, raw string")

    def search(some, stop=None):
        if stop and some.where("row_index = 6").count():
            stop()
        return some.select("row_index", F.lit("has_result").alias("status"), F.lit("{}").alias("outcome"))

    def fail():
        raise ValueError("broken at the third")

    assert store.run(key, store.begin(key, rows, "poem"), lambda some: search(some, fail), 2) == "failed"
    assert store.status(key)["finished_rows"] == 4 and store.find(key)["error"] == "broken at the third"
    left = store.begin(key, rows, "poem", "unresolved")
    assert sorted(r["row_index"] for r in left.collect()) == [6, 9, 12]
    assert store.run(key, left, lambda some: search(some, lambda: store.cancel(key)), 1) == "cancelled"
    assert store.status(key)["finished_rows"] in (4, 5)
    assert store.run(key, store.begin(key, rows, "poem", "unresolved"), search, 2) == "done"
    assert store.status(key)["finished_rows"] == 7 and store.results(key).select("row_index").distinct().count() == 7


def test_export_of_a_workbook(spark, engine, tmp_path):
    path = str(tmp_path / "in.xlsx")
    xlsx.write(path, ["poem", "note"], [["星垂平野闊", 1], ["龘龘龘龘", None]])
    store = jobs.Jobs(spark, str(tmp_path / "jobs"))
    key = api.batch_upload(store, path, "book")["job_id"]
    api.batch_start(engine, store, key, "poem")
    out = str(tmp_path / "out.xlsx")
    api.batch_export(store, key, ["status", "title"], out)
    back = [json.loads(r["raw"]) for r in xlsx.read(spark, out).orderBy("row_index").collect()]
    assert [b["han_title"] for b in back] == ["旅夜書懷", None] and back[0]["note"] == 1 and back[1]["poem"] == "龘龘龘龘"


def test_additions(spark, engine, tmp_path):
    store = api.Additions(engine, str(tmp_path / "added"))
    rows = spark.createDataFrame([(0, "題", "人", "細草微風岸危檣獨"), (1, "題", "人", "細草，微風岸危檣獨"), (2, "", "人", "細草微風岸"), (3, "旅夜書懷", "杜甫", NIGHT)], "row_index int, title string, author string, text string")
    got = {r["row_index"]: r["result"] for r in store.add(rows, "agent").collect()}
    assert got[0] == "added" and got[1] == "duplicate" and got[2] == "error"
    held = store.listed("pending", "agent").collect()
    assert len(held) == list(got.values()).count("added")
    decisions = spark.createDataFrame([(held[0]["addition_id"], "accepted"), ("none", "accepted")], "addition_id string, decision string")
    assert sorted(r["review"] for r in store.review(decisions).collect()) == ["applied", "not_found"]
    assert [r["review"] for r in store.review(decisions.limit(1)).collect()] == ["not_pending"]
    assert store.stats()["agent_accepted"] == 1 and store.stats()["total"] == 1
    assert {r["result"] for r in store.add(rows.where("row_index = 0")).collect()} == {"duplicate"}
    for bad in (lambda: store.listed("odd"), lambda: store.add(rows, "odd")):
        with pytest.raises(api.RequestError):
            bad()


def test_models_as_plug_ins(spark, engine):
    made = []

    def factory():
        made.append(1)
        return service.HashEmbedder()

    assert service.loaded(factory, "t") is service.loaded(factory, "t") and len(made) == 1
    assert api.unload("t") == {"unloaded": True} and api.unload("t") == {"unloaded": False}
    frame = spark.createDataFrame([(1, "天地日月"), (2, " "), (3, None), (4, "天地日月")], "id int, text string")
    got = {r["id"]: r["vector"] for r in service.embedded(frame, "text", service.HashEmbedder, "h", batch=1).collect()}
    assert got[2] is None and got[3] is None and got[1] == got[4] and sum(x * x for x in got[1]) == pytest.approx(1)
    one = api.embed(service.HashEmbedder(), ["天地日月"])
    assert one["dim"] == 64 and one["vectors"][0] == pytest.approx(got[1], abs=1e-6)
    assert api.rerank(service.OverlapReranker(), "天地", ["天", "日"])["scores"] == [0.5, 0.0]
    scored = service.scorer(service.OverlapReranker, "o")(spark.createDataFrame([("天地", "天"), (None, "x")], "query string, content string"))
    assert [r["rerank_score"] for r in scored.collect()] == [0.5, 0.0]
    assert service.described(service.HashEmbedder())["model_id"] == "hash-64"


def test_requests():
    api.embed_request(["a"])
    api.rerank_request("q", ["d"])
    for bad in ([], [" "], ["a"] * 513):
        with pytest.raises(api.RequestError):
            api.embed_request(bad)
    with pytest.raises(api.RequestError):
        api.rerank_request(" ", ["d"])


def test_found_evidence_comes_first(spark):
    local = spark.createDataFrame([("r", "1"), ("r", "2")], "run_id string, id string")
    found = spark.createDataFrame([("r", "2"), ("r", "3")], "run_id string, id string")
    assert [(r["list_ord"], r["id"]) for r in agent.with_found(local, found).orderBy("list_ord", "id").collect()] == [(0, "3"), (1, "1"), (1, "2")]
