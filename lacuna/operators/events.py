"""The event log of searches: sequence numbers, replay, and the fold of a log into the state of its run.

Events are (run_id, seq, step, source, phase, status, flags, message, metadata fields). The fold is one aggregation by
step and one by run; order matters through seq alone, so it may be computed from events in any order and again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Statuses of a step, and those that are failures.
STATUSES = ("has_result", "no_result", "low_confidence", "error", "timeout", "unavailable", "skipped", "not_executed")
FAILURES = ("error", "timeout", "unavailable")
SETTLED = ("has_result", "skipped")

# Steps and phases of a search.
STEPS = (
    "query_understanding", "normalization", "local_search", "exact", "bm25", "vector", "hybrid", "reranker",
    "local_evaluation", "agent", "tool_call", "aggregation", "rule_verification", "llm_verification", "final_answer",
)
PHASES = ("started", "completed", "failed")

SCHEMA = """run_id string, seq bigint, ts timestamp, step string, source string, phase string, status string, flags array<string>,
agent_iteration int, message string, latency_ms double, result_count bigint, top_score double, confidence double, error_code string,
error_message string, cost_usd double, tokens_in bigint, tokens_out bigint"""
VALUES = ("latency_ms", "result_count", "top_score", "confidence", "error_code", "error_message", "message", "agent_iteration")


def is_productive(status: Column) -> Column:
    return status == "has_result"


def is_failure(status: Column) -> Column:
    return status.isin(*FAILURES)


def is_settled(status: Column) -> Column:
    return status.isin(*SETTLED)


def source_flag(source: Column, status: Column) -> Column:
    return F.concat_ws("_", source, status)


def sequenced(events: DataFrame, *order: str) -> DataFrame:
    """Events numbered from 0 within their run."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy("run_id").orderBy(*order)) - 1)


def first_wins(events: DataFrame) -> DataFrame:
    """One event for each (run_id, seq): the earliest by time, then by content."""
    first = Window.partitionBy("run_id", "seq").orderBy("ts", F.xxhash64(*[c for c in events.columns if c not in ("ts", "flags")]))
    return events.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def after(events: DataFrame, last_seq: Column | int | None) -> DataFrame:
    """What a client that has seen last_seq still needs; all of it where the number isn't one."""
    if last_seq is None:
        return events
    return events.where(F.col("seq") > F.coalesce(F.lit(last_seq) if isinstance(last_seq, int) else last_seq, F.lit(-1)))


def status_of(phase: Column, status: Column) -> Column:
    return F.coalesce(status, F.when(phase == "started", "not_executed").when(phase == "failed", "error").otherwise("has_result"))


def fold_steps(events: DataFrame) -> DataFrame:
    """(run_id, step, source, status, ...): the last status of each step, the last of each other value, and where it began and ended."""
    status = F.max_by(status_of(F.col("phase"), F.col("status")), "seq")
    last = [F.max_by(F.col(v), F.when(F.col(v).isNotNull(), F.col("seq"))).alias(v) for v in VALUES if v in events.columns]
    return events.groupBy("run_id", "step", "source").agg(
        status.alias("status"),
        F.max(F.when(F.col("phase") == "started", F.col("seq"))).alias("started_at_seq"),
        F.max(F.when(F.col("phase") != "started", F.col("seq"))).alias("completed_at_seq"),
        F.min("seq").alias("first_seq"),
        *last,
    )


def first_seen(log: DataFrame) -> DataFrame:
    """(run_id, flags): the distinct flags of a run in order of first appearance. Copies are merged before a run is gathered."""
    each = log.select("run_id", "seq", F.posexplode("flags").alias("place", "flag")).groupBy("run_id", "flag").agg(F.min(F.struct("seq", "place")).alias("at"))
    return each.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "flag"))), lambda x: x["flag"]).alias("flags"))


def fold_runs(events: DataFrame) -> DataFrame:
    """(run_id, last_seq, applied, steps, order, flags, agent_iterations, total_cost_usd, tokens, finished, failed_steps)."""
    steps = fold_steps(events).withColumn("key", F.concat_ws(":", "step", "source"))
    order = F.transform(F.array_sort(F.collect_list(F.struct("first_seq", "key"))), lambda x: x["key"])
    per_run = steps.groupBy("run_id").agg(F.count("*").alias("steps"), order.alias("order"), F.count_if(is_failure(F.col("status"))).alias("failed_steps"))
    totals = events.groupBy("run_id").agg(
        F.max("seq").alias("last_seq"),
        F.count("*").alias("applied"),
        F.coalesce(F.max(F.col("agent_iteration") + 1), F.lit(0)).alias("agent_iterations"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_cost_usd"),
        F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"),
        F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"),
        F.max((F.col("step") == "final_answer") & (F.col("phase") != "started")).alias("finished"),
    )
    flags = F.coalesce("flags", F.array().cast("array<string>")).alias("flags")
    return totals.join(per_run, "run_id").join(first_seen(events), "run_id", "left").withColumn("flags", flags)


def failed_sources(events: DataFrame) -> DataFrame:
    return fold_steps(events).where(is_failure(F.col("status"))).select("run_id", "step", "source", "status")


def run_cost(events: DataFrame) -> DataFrame:
    return events.groupBy("run_id").agg(F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("cost_usd"))


def violations(events: DataFrame) -> DataFrame:
    """Events that break the contract, with the first rule that each breaks."""
    rule = (
        F.when(F.col("seq").isNull() | (F.col("seq") < 0), "seq")
        .when(F.col("step").isNull() | ~F.col("step").isin(*STEPS), "step")
        .when(F.col("phase").isNull() | ~F.col("phase").isin(*PHASES), "phase")
        .when(F.col("status").isNotNull() & ~F.col("status").isin(*STATUSES), "status")
        .when((F.col("status") == "no_result") & (F.col("result_count") > 0), "count")
        .when((F.col("status") == "has_result") & (F.col("result_count") < 1), "count")
    )
    return events.withColumn("rule", rule).where("rule is not null")
