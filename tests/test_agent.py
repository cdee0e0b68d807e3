import time

import pytest
from pyspark.sql import functions as F

from lacuna.config import Settings
from lacuna.operators import agent


def tool(function=lambda q: [{"id": q, "content": "天地" * 30}], **more):
    return agent.FunctionTool("search", "local", function, **more)


def test_run_tool():
    assert agent.run_tool(tool(), {"query": "天地"}).status == "has_result"
    assert agent.run_tool(tool(lambda q: []), {"query": "天地"}).status == "no_result"
    assert agent.run_tool(tool(), {"query": "x"}).status == agent.run_tool(tool(), {}).status == "error"
    assert agent.run_tool(tool(reason="off"), {"query": "天地"}) == agent.ToolResult("unavailable", error="off", code="tool_unavailable")
    assert agent.run_tool(tool(lambda q: time.sleep(1) or [], seconds=0.05), {"query": "天地"}).status == "timeout"
    assert "division" in agent.run_tool(tool(lambda q: [1 / 0]), {"query": "天地"}).error
    with pytest.raises(ValueError):
        agent.ToolResult("has_result")


def test_failures_have_a_code_and_a_time():
    def failing(code):
        def run(q):
            raise agent.ToolError(code, "why")

        return agent.run_tool(tool(run), {"query": "天地"})

    assert failing("tool_unavailable") == agent.ToolResult("unavailable", error="why", code="tool_unavailable")
    assert failing("tool_timeout").status == "timeout" and failing("http_error").code == "http_error"
    slow = agent.run_tool(tool(lambda q: time.sleep(0.1) or [{"id": q}]), {"query": "天地"})
    assert slow.status == "has_result" and slow.seconds >= 0.1
    gave_up = agent.run_tool(tool(lambda q: time.sleep(1) or []), {"query": "天地"}, aborted=lambda: True)
    assert (gave_up.status, gave_up.code) == ("error", "aborted") and gave_up.seconds < 0.5
    assert agent.run_agent("q", lambda m: CALL, {"search": tool()}, aborted=lambda: True).stopped == "aborted"


def test_violations(spark):
    rows = [("no_result", ["x"], 1), ("has_result", [], 0), ("has_result", None, 0), ("low_confidence", ["x"], 2), ("has_result", ["x"], 1), ("no_result", [], 0)]
    got = agent.violations(spark.createDataFrame(rows, "status string, rows array<string>, result_count int")).collect()
    assert sorted(r["rule"] for r in got) == ["count", "result_without_rows", "result_without_rows", "rows_without_result"]


def test_pages_are_paced_and_kept():
    now, waited, fetched = [0.0], [], []

    def sleep(seconds):
        waited.append(seconds)
        now[0] += seconds

    cache = agent.PageCache(lambda k: fetched.append(k) or f"page {k}", pause=2.0, ttl=10.0, most=2, clock=lambda: now[0], sleep=sleep)
    assert cache.get("a") == "page a" and cache.get("a") == "page a" and fetched == ["a"] and not waited
    now[0] += 0.5
    cache.get("b")
    assert waited == [1.5]
    cache.get("c")
    assert set(cache.pages) == {"b", "c"}
    now[0] += 20
    cache.get("b")
    assert fetched == ["a", "b", "c", "b"] and list(cache.pages) == ["c", "b"]


PAGE = "".join(f"<div id='poem_title_{i}'><a href='/p/{i}'>詩{i}</a></div><div id='poem_content_{i}'><div class='poemSentence'>細草</div></div>" for i in range(12))


def test_web_tool():
    pages = {"天地": PAGE, "日月": "<p>没有找到</p>", "odd": "<p>login</p>"}

    def fetch(key):
        if key == "down":
            raise agent.ToolError("http_error", "503")
        return pages[key]

    web = agent.web_tool(agent.PageCache(fetch, pause=0))
    found = agent.run_tool(web, {"query": "天地"})
    assert found.status == "has_result" and len(found.rows) == 8 and found.rows[0]["content"] == "細草" and found.rows[0]["url"].endswith("/p/0")
    assert agent.run_tool(web, {"query": "日月"}).status == "no_result"
    assert agent.run_tool(web, {"query": "odd"}).code == "unexpected_page" and agent.run_tool(web, {"query": "down"}).code == "http_error"
    assert agent.run_tool(agent.web_tool(None), {"query": "天地"}).status == "unavailable"
    assert agent.run_tool(web, {"query": "天" * 61}).code == "bad_arguments"


def test_registry():
    tools = agent.registry(tool(), agent.web_tool(None), agent.ask_model_tool(lambda q: "x"))
    assert list(tools) == ["search", "search_web", "ask_model"]
    assert [t["name"] for t in agent.offered(tools)] == ["search", "ask_model"]
    with pytest.raises(ValueError):
        agent.registry(tool(), tool())


def test_responses(spark):
    rows = [(1, 0, "m", None, "he", 0, 0, None, None, None), (1, 1, "m", "m-1", "llo", 0, 0, 1000, 10, 500), (2, 0, "m", None, None, 0, 0, None, None, None), (3, 0, "m", "other", None, 1, 1, None, None, None)]
    chunks = spark.createDataFrame(rows, "response_id int, seq int, requested string, model string, text string, tool_calls int, bad_arguments int, tokens_in bigint, tokens_out bigint, cached bigint")
    prices = spark.createDataFrame([("m-1", 2.0, 4.0, 1.0)], "model string, rate_in double, rate_out double, rate_cached double")
    got = {r["response_id"]: r for r in agent.responses(chunks, prices).collect()}
    assert got[1]["text"] == "hello" and got[1]["status"] == "done" and got[1]["cost_usd"] == pytest.approx((500 * 2 + 500 * 1 + 10 * 4) / 1e6) and got[1]["flags"] == []
    assert (got[2]["status"], got[2]["error_code"], got[2]["flags"], got[2]["cost_usd"]) == ("error", "empty_reply", ["usage_unavailable"], None)
    assert got[3]["status"] == "tool_use" and got[3]["flags"] == ["bad_tool_args", "model_substituted", "usage_unavailable"]


def provider(*replies):
    left = list(replies)
    return lambda messages: left.pop(0) if left else {"cost_usd": 0.0}


CALL = {"tool_calls": [{"name": "search", "arguments": {"query": "天地"}}], "cost_usd": 0.2}


def test_loop():
    done = agent.run_agent("q", provider(CALL, CALL), {"search": tool()})
    assert done.stopped == "done" and done.iterations == 3 and done.tool_calls == 2
    assert len(done.evidence) == 1 and done.flags == ("model_has_result",) and done.statuses == {"local": "has_result"}


def test_budgets():
    always = lambda m: CALL
    assert agent.run_agent("q", always, {"search": tool()}, Settings(max_iterations=2)).iterations == 2
    assert agent.run_agent("q", always, {"search": tool()}, Settings(max_tool_calls=1)).tool_calls == 1
    cost = agent.run_agent("q", always, {"search": tool()}, Settings(max_cost_usd=0.3))
    assert cost.iterations == 2 and cost.stopped == "budget_exhausted" and "agent_budget_exhausted" in cost.flags
    free = agent.run_agent("q", lambda m: CALL | {"cost_usd": None}, {"search": tool()}, Settings(max_cost_usd=0.0001, max_iterations=3))
    assert free.iterations == 3 and "usage_unavailable" in free.flags
    assert agent.run_agent("q", always, {"search": tool(reason="off")}).stopped == "no_tools_available"


def test_failover():
    def broken(code):
        def ask(messages):
            raise agent.ProviderError(code)
        return ask

    assert agent.with_failover(broken("timeout"), provider({"text": "x"}))([])["flags"] == ["llm_failover"]
    for code, fallback in (("aborted", provider({})), ("timeout", None)):
        with pytest.raises(agent.ProviderError):
            agent.with_failover(broken(code), fallback)([])
    assert agent.run_agent("q", broken("timeout"), {"search": tool()}).stopped == "model_failed"


def test_compact(spark):
    rows = spark.createDataFrame([("r", 0, "a", "no_result", 0, None), ("r", 1, "a", "has_result", 0, "x" * 50), ("r", 1, "a", "has_result", 1, "y")], "run_id string, seq int, source string, status string, rank int, content string")
    got = agent.compact(rows, most=1).first()
    assert got["statuses"] == {"a": "has_result"} and got["candidates"] == ["x" * 40]


def test_messages(spark):
    rows = [("T", None, "c", "s", ["local_result_found"], False), (None, None, "c" * 40, "web", [], True), (None, None, None, None, [], False), ("T", "A", "c", "s", ["no_local_result"], False)]
    frame = spark.createDataFrame(rows, "t string, a string, c string, s string, f array<string>, p boolean")
    got = [r["m"] for r in frame.select(agent.answer_message(*[F.col(x) for x in "tacsfp"]).alias("m")).collect()]
    assert got[0] == "T / (unknown)" and got[1] == "c" * 30 + " / from web (partial: the budget ran out)" and got[2] == "No confident answer" and "nothing" in got[3]


def test_assembled(spark):
    rows = [(1, 0, 0, "search", '{"q"'), (1, 1, 0, None, ': "x"}'), (1, 2, 1, "other", "oops")]
    got = {r["index"]: r for r in agent.assembled(spark.createDataFrame(rows, "response_id int, seq int, index int, name string, arguments string")).collect()}
    assert got[0]["name"] == "search" and got[0]["raw_arguments"] == '{"q": "x"}' and got[0]["valid"] and not got[1]["valid"]
