"""Budgets, routing, tools and state of the agent loop. Tools are pluggable; none here uses a network."""

from __future__ import annotations

import concurrent.futures
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.config import Settings
from lacuna.functions import numbers, text
from lacuna.sources import html


def first_violation(steps: DataFrame, s: Settings = Settings()) -> DataFrame:
    """steps (run_id, seq, kind: llm or tool, ts, cost_usd) to (run_id, seq, exhausted): the first step that a budget forbids.

    Budgets are looked at before a step, in order: iterations, tool calls, time since the first step, cost. A step of
    unknown cost suspends the cost budget for the rest of the run."""
    earlier = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("run_id")
    spent = steps.withColumns({
        "iterations": F.coalesce(F.count_if(F.col("kind") == "llm").over(earlier), F.lit(0)),
        "tools": F.coalesce(F.count_if(F.col("kind") == "tool").over(earlier), F.lit(0)),
        "seconds": F.unix_micros("ts") / 1e6 - F.unix_micros(F.min("ts").over(whole)) / 1e6,
        "cost": F.coalesce(F.sum("cost_usd").over(earlier), F.lit(0.0)),
        "unknown": F.coalesce(F.count_if(F.col("cost_usd").isNull()).over(earlier), F.lit(0)),
    })
    exhausted = (
        F.when(F.col("iterations") >= s.max_iterations, "iterations")
        .when(F.col("tools") >= s.max_tool_calls, "tool_calls")
        .when(F.col("seconds") >= s.max_seconds, "wall_clock")
        .when((F.col("unknown") == 0) & (F.col("cost") >= s.max_cost_usd), "cost")
    )
    broken = spent.withColumn("exhausted", exhausted).where("exhausted is not null")
    return broken.groupBy("run_id").agg(F.min(F.struct("seq", "exhausted")).alias("x")).select("run_id", "x.*")


def route(found: Column, kind: Column, overlap: Column, enabled: Column, available: Column, skip_without_overlap: bool = True) -> Column:
    """What happens to a query next: answered, skipped, unavailable or run."""
    hopeless = F.lit(skip_without_overlap) & (kind == "none") & F.coalesce(overlap == 0, F.lit(False))
    return F.when(found, "answered").when(hopeless, "skipped").when(~enabled, "skipped").when(~available, "unavailable").otherwise("run")


def agent_status(evidence: Column, stopped: Column) -> Column:
    return F.when(evidence > 0, "has_result").when(stopped == "model_failed", "error").when(stopped == "no_tools_available", "skipped").when(stopped == "budget_exhausted", "low_confidence").otherwise("no_result")


def final_status(local: Column, flags: Column, evidence: Column, verdict: Column) -> Column:
    """The local status, unless a model found what the corpus lacks and no judge called it insufficient."""
    helped = (local == "no_result") & F.array_contains(flags, "model_has_result") & (evidence > 0) & (F.coalesce(verdict, F.lit("")) != "insufficient")
    return F.when(helped, "low_confidence").otherwise(local)


def answer_message(title: Column, author: Column, content: Column, source: Column, flags: Column, partial: Column) -> Column:
    """The answer in words: nothing, a work of the corpus, or something from outside."""
    nothing = F.lit("No confident answer")
    said = (
        F.when(F.array_contains(flags, "no_local_result"), F.concat(nothing, F.lit(": nothing in the corpus matches")))
        .when(content.isNull(), nothing)
        .when(F.array_contains(flags, "local_result_found"), F.concat(F.coalesce(title, F.lit("(untitled)")), F.lit(" / "), F.coalesce(author, F.lit("(unknown)"))))
        .otherwise(F.concat(F.coalesce(title, F.substring(content, 1, 30)), F.lit(" / from "), source))
    )
    return F.concat(said, F.when(partial, F.lit(" (partial: the budget ran out)")).otherwise(F.lit("")))


def compact(results: DataFrame, most: int = 5, snippet: int = 40) -> DataFrame:
    """results (run_id, seq, source, status, rank, content) to the state a model is shown: statuses, a few short candidates."""
    statuses = results.groupBy("run_id", "source").agg(F.max_by("status", "seq").alias("status")).groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "status")))).alias("statuses"))
    first = Window.partitionBy("run_id").orderBy("seq", "rank")
    top = results.where("content is not null").withColumn("n", F.row_number().over(first)).where(F.col("n") <= most)
    shown = top.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.substring("content", 1, snippet).alias("c")))), lambda x: x["c"]).alias("candidates"))
    return statuses.join(shown, "run_id", "left")


def with_found(local: DataFrame, found: DataFrame) -> DataFrame:
    """Evidence of a run with what an agent found that it didn't have by id, first."""
    new = found.join(local.select("run_id", "id"), ["run_id", "id"], "left_anti").withColumn("list_ord", F.lit(0))
    return new.unionByName(local.withColumn("list_ord", F.lit(1)))


class Tool(Protocol):
    name: str
    source: str
    seconds: float

    def unavailable(self) -> str | None: ...

    def check(self, arguments: dict[str, Any]) -> str | None: ...

    def execute(self, arguments: dict[str, Any]) -> list[dict[str, Any]]: ...


class ToolError(RuntimeError):
    """What a tool raises to say which status its failure has."""

    def __init__(self, code: str, message: str = "") -> None:
        super().__init__(message or code)
        self.code = code


@dataclass(frozen=True)
class ToolResult:
    """no_result has no row, has_result one or more. code names the fault, seconds the time it took."""

    status: str
    rows: tuple[dict[str, Any], ...] = ()
    error: str | None = None
    code: str | None = None
    seconds: float = field(default=0.0, compare=False)

    def __post_init__(self) -> None:
        if (self.status == "no_result" and self.rows) or (self.status == "has_result" and not self.rows):
            raise ValueError(f"{self.status} with {len(self.rows)} rows")


def violations(results: DataFrame) -> DataFrame:
    """results (status, result_count, rows: array) that contradict themselves, with the rule that each breaks."""
    size = F.coalesce(F.size("rows"), F.lit(0))
    rule = F.when((F.col("status") == "no_result") & (size > 0), "rows_without_result").when((F.col("status") == "has_result") & (size < 1), "result_without_rows").when(F.col("result_count") != size, "count")
    return results.withColumn("rule", rule).where("rule is not null")


POLL = 0.02


def run_tool(tool: Tool, arguments: dict[str, Any], aborted: Callable[[], bool] = lambda: False, clock: Callable[[], float] = time.monotonic) -> ToolResult:
    """A tool's result with the time it took; whatever goes wrong becomes a status and nothing is raised.

    A caller that gives up gets an error, a tool that takes too long a timeout, one that says it is unavailable just that."""
    began = clock()

    def failed(status: str, code: str, message: str) -> ToolResult:
        return ToolResult(status, error=message, code=code, seconds=clock() - began)

    if reason := tool.unavailable():
        return failed("unavailable", "tool_unavailable", reason)
    if issue := tool.check(arguments):
        return failed("error", "bad_arguments", f"bad arguments: {issue}")
    pool = concurrent.futures.ThreadPoolExecutor(1)
    try:
        running = pool.submit(tool.execute, arguments)
        while True:
            if aborted():
                return failed("error", "aborted", "the caller gave up")
            left = tool.seconds - (clock() - began)
            if left <= 0:
                return failed("timeout", "tool_timeout", f"took more than {tool.seconds:g} s")
            done, _ = concurrent.futures.wait([running], timeout=min(POLL, left))
            if done:
                break
        found = running.result()
        if not isinstance(found, ToolResult):
            rows = tuple(found)
            found = ToolResult("has_result" if rows else "no_result", rows)
        return replace(found, seconds=clock() - began)
    except ToolError as error:
        return failed("unavailable" if error.code == "tool_unavailable" else "timeout" if error.code == "tool_timeout" else "error", error.code, str(error))
    except Exception as error:  # a tool may raise anything
        return failed("error", "internal", str(error))
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


@dataclass(frozen=True)
class FunctionTool:
    """A tool around a function; searches of a corpus take 2 to 500 characters."""

    name: str
    source: str
    function: Callable[[str], Iterable[dict[str, Any]]]
    seconds: float = 10.0
    reason: str | None = None
    least: int = 2
    most: int = 500

    def unavailable(self) -> str | None:
        return self.reason

    def check(self, arguments: dict[str, Any]) -> str | None:
        query = arguments.get("query")
        if not isinstance(query, str):
            return "query must be a text"
        return None if self.least <= len(query) <= self.most else f"query must have {self.least} to {self.most} characters"

    def execute(self, arguments: dict[str, Any]) -> list[dict[str, Any]] | ToolResult:
        found = self.function(arguments["query"])
        return found if isinstance(found, ToolResult) else list(found)


def ask_model_tool(provider: Callable[[str], str] | None) -> FunctionTool:
    """What a model says of a query: any text is a result, without a source."""
    def ask(query: str) -> list[dict[str, Any]]:
        said = (provider(query) if provider else "").strip()
        return [{"id": None, "content": said, "source": "model", "url": None}] if said else []

    return FunctionTool("ask_model", "model", ask, reason=None if provider else "no model is configured")


class PageCache:
    """Pages by key, fetched at most every `pause` seconds, kept for `ttl` seconds, `most` of them: the oldest goes first."""

    def __init__(self, fetch: Callable[[str], str], pause: float = 1.0, ttl: float = 3600.0, most: int = 200, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.fetch, self.pause, self.ttl, self.most, self.clock, self.sleep = fetch, pause, ttl, most, clock, sleep
        self.pages: dict[str, tuple[float, str]] = {}
        self.last = float("-inf")

    def get(self, key: str) -> str:
        held = self.pages.get(key)
        if held and self.clock() - held[0] < self.ttl:
            return held[1]
        if (wait := self.last + self.pause - self.clock()) > 0:
            self.sleep(wait)
        self.last = self.clock()
        page = self.fetch(key)
        self.pages.pop(key, None)
        self.pages[key] = (self.clock(), page)
        while len(self.pages) > self.most:
            del self.pages[next(iter(self.pages))]
        return page


def web_tool(cache: PageCache | None, seconds: float = 15.0, longest: int = 60) -> FunctionTool:
    """A poem site as a tool: the first hits of its result page. Fetching is the cache's, nothing here uses a network."""
    def ask(query: str) -> list[dict[str, Any]]:
        page = cache.get(query) if cache else ""
        hits = html.parsed(page)[: html.FIRST_HITS]
        if not hits and not any(word in page for word in html.RESULT_PAGE):
            raise ToolError("unexpected_page", "the page isn't a result page; its markup may have changed")
        return [{"id": f"web:{h['id']}", "title": h["title"], "author": h["author"], "dynasty": h["dynasty"], "content": "\n".join(h["lines"]), "url": h["url"], "source": "web"} for h in hits]

    return FunctionTool("search_web", "web", ask, seconds, None if cache else "web search is switched off", most=longest)


def registry(*tools: Tool) -> dict[str, Tool]:
    """Tools by name, in the order in which a model is shown them."""
    out: dict[str, Tool] = {}
    for tool in tools:
        if tool.name in out:
            raise ValueError(f"two tools are called {tool.name}")
        out[tool.name] = tool
    return out


def offered(tools: dict[str, Tool]) -> list[dict[str, Any]]:
    """What a model is told of the tools that can run."""
    return [{"name": t.name, "source": t.source, "arguments": {"query": {"type": "string", "least": getattr(t, "least", None), "most": getattr(t, "most", None)}}} for t in tools.values() if t.unavailable() is None]


class ProviderError(RuntimeError):
    def __init__(self, code: str, message: str = "") -> None:
        super().__init__(message or code)
        self.code = code


Provider = Callable[[list[dict[str, Any]]], dict[str, Any]]


def with_failover(primary: Provider, fallback: Provider | None) -> Provider:
    """Ask the fallback where the primary times out, is unavailable or breaks; never after the caller gave up."""
    def ask(messages: list[dict[str, Any]]) -> dict[str, Any]:
        try:
            return primary(messages)
        except ProviderError as error:
            if fallback is None or error.code not in ("timeout", "unavailable", "internal"):
                raise
            reply = fallback(messages)
            return reply | {"flags": [*reply.get("flags", []), "llm_failover"]}

    return ask


@dataclass(frozen=True)
class AgentState:
    query: str
    statuses: dict[str, str] = field(default_factory=dict)
    evidence: tuple[dict[str, Any], ...] = ()
    iterations: int = 0
    tool_calls: int = 0
    cost_usd: float = 0.0
    cost_unknown: bool = False
    flags: tuple[str, ...] = ()
    stopped: str | None = None


def run_agent(query: str, provider: Provider, tools: dict[str, Tool], s: Settings = Settings(), clock: Callable[[], float] = time.monotonic, aborted: Callable[[], bool] = lambda: False) -> AgentState:
    """The loop: the provider names a tool and its arguments, or is done; budgets are looked at before each call."""
    state, began = AgentState(query), clock()
    if not any(t.unavailable() is None for t in tools.values()):
        return replace(state, stopped="no_tools_available")

    def exhausted() -> bool:
        return state.iterations >= s.max_iterations or state.tool_calls >= s.max_tool_calls or clock() - began >= s.max_seconds or (not state.cost_unknown and state.cost_usd >= s.max_cost_usd)

    while True:
        if aborted():
            return replace(state, stopped="aborted")
        if exhausted():
            return replace(state, stopped="budget_exhausted", flags=(*state.flags, "agent_budget_exhausted"))
        try:
            reply = provider([{"query": query, "statuses": dict(state.statuses), "candidates": [str(e.get("content", ""))[:40] for e in state.evidence[:5]]}])
        except ProviderError:
            return replace(state, stopped="model_failed", flags=(*state.flags, "agent_model_failed"))
        cost = reply.get("cost_usd")
        unknown = ("usage_unavailable",) if cost is None and "usage_unavailable" not in state.flags else ()
        state = replace(state, iterations=state.iterations + 1, cost_usd=state.cost_usd + (cost or 0.0), cost_unknown=state.cost_unknown or cost is None, flags=(*state.flags, *(f for f in reply.get("flags", []) if f not in state.flags), *unknown))
        calls = reply.get("tool_calls") or []
        if not calls:
            return replace(state, stopped="done")
        for call in calls:
            if state.tool_calls >= s.max_tool_calls:
                break
            tool = tools.get(call.get("name", ""))
            result = run_tool(tool, call.get("arguments") or {}, aborted) if tool else ToolResult("error", error="no such tool")
            held = {e.get("id") for e in state.evidence}
            new = tuple(r for r in result.rows if r.get("id") is None or r.get("id") not in held)
            source = tool.source if tool else call.get("name", "?")
            found = ("model_has_result",) if new and "model_has_result" not in state.flags else ()
            state = replace(state, tool_calls=state.tool_calls + 1, statuses={**state.statuses, source: result.status}, evidence=(*state.evidence, *new), flags=(*state.flags, *found))


def assembled(chunks: DataFrame) -> DataFrame:
    """Streamed deltas (response_id, seq, index, name, arguments) to one row for each tool call, its pieces in order.

    Arguments that aren't JSON stay as text in raw_arguments."""
    pieces = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("arguments", F.lit("")).alias("a")))), lambda x: x["a"]), "")
    calls = chunks.groupBy("response_id", "index").agg(F.max_by("name", F.when(F.col("name").isNotNull(), F.col("seq"))).alias("name"), pieces.alias("raw_arguments"))
    return calls.withColumn("valid", F.try_parse_json("raw_arguments").isNotNull())


def responses(chunks: DataFrame, prices: DataFrame) -> DataFrame:
    """Deltas (response_id, seq, requested, model, text, tool_calls, bad_arguments, tokens_in, tokens_out, cached) to one row for each response.

    status is error where a response has neither text nor tool calls. Without usage the cost is null and a flag says so;
    prices (model, rate_in, rate_out, rate_cached) are of the served model."""
    pieces = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "")
    last = {c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in ("model", "tokens_in", "tokens_out", "cached")}
    whole = chunks.groupBy("response_id", "requested").agg(pieces.alias("text"), F.coalesce(F.sum("tool_calls"), F.lit(0)).alias("tool_calls"), F.coalesce(F.sum("bad_arguments"), F.lit(0)).alias("bad_arguments"), *last.values())
    whole = whole.withColumn("model", F.coalesce("model", "requested")).join(F.broadcast(prices), "model", "left")
    usage = F.col("tokens_in").isNotNull() | F.col("tokens_out").isNotNull()
    counts = [F.coalesce(c, F.lit(0)) for c in ("tokens_in", "tokens_out", "cached")]
    cost = F.when(usage, numbers.token_cost(*counts, F.col("rate_in"), F.col("rate_out"), F.col("rate_cached")))
    empty = (F.length("text") == 0) & (F.col("tool_calls") == 0)
    flags = F.array_compact(F.array(F.when(F.col("bad_arguments") > 0, "bad_tool_args"), F.when(text.substituted(F.col("requested"), F.col("model")), "model_substituted"), F.when(~usage, "usage_unavailable")))
    return whole.select("response_id", "model", "text", "tool_calls", F.when(empty, "error").when(F.col("tool_calls") > 0, "tool_use").otherwise("done").alias("status"), F.when(empty, "empty_reply").alias("error_code"), cost.alias("cost_usd"), flags.alias("flags"))
