"""Catalogue: event log, budgets, batches, additions, evaluation, costs and plain relational shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacuna.config import LETTERS, Settings
from lacuna.functions import keys, numbers, text
from lacuna.operators import additions, agent, batch, columns, evaluate, events
from lacuna.plans.inputs import HAN_OF, MATCH, Catalogue, Inline, WithTable, in_han, poems, table
from lacuna.sources import html

C = Catalogue()


def _with_table(cases: Inline, made: dict[str, str], name: str) -> WithTable:
    """Inline cases and a row for each of a table, by expressions that both engines know."""
    columns = [f"{v} as {k}" for k, v in made.items()]
    return WithTable(cases, f"select {', '.join(columns)} from {name}", lambda spark, sf_dir: table(spark, sf_dir, name).selectExpr(*columns))

# The log: a user is a run, an event type a step, and k of the properties gives phase, iteration and count.
LOG_SQL = """raw as (select *, cast(regexp_extract(props, '(\\d+)', 1) as int) as k from events),
log as (
  select cast(user_id as varchar) as run_id, row_number() over (partition by user_id order by ts, event_id) - 1 as seq, ts, event_type as step, 'source' || (k % 2) as source,
    case k % 3 when 0 then 'started' when 1 then 'completed' else 'failed' end as phase, case when k % 7 = 0 then 'timeout' end as status, k % 5 as agent_iteration, k as result_count, value as cost_usd,
    event_type || '_' || (k % 2) as flag
  from raw
)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    raw = table(spark, sf_dir, "events").withColumn("k", k).withColumn("run_id", F.col("user_id").cast("string"))
    numbered = events.sequenced(raw, "ts", "event_id")
    return numbered.select(
        "run_id", "seq", "ts", F.col("event_type").alias("step"), F.concat(F.lit("source"), (F.col("k") % 2).cast("string")).alias("source"),
        F.when(F.col("k") % 3 == 0, "started").when(F.col("k") % 3 == 1, "completed").otherwise("failed").alias("phase"), F.when(F.col("k") % 7 == 0, "timeout").alias("status"),
        F.array(F.concat_ws("_", "event_type", (F.col("k") % 2).cast("string"))).alias("flags"), (F.col("k") % 5).alias("agent_iteration"), F.col("k").cast("bigint").alias("result_count"),
        F.col("value").alias("cost_usd"), F.lit(None).cast("bigint").alias("tokens_in"), F.lit(None).cast("bigint").alias("tokens_out"),
    )


@C.add("event_seq", f"with {LOG_SQL} select run_id, seq, step, source, phase from log")
def event_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).select("run_id", F.col("seq").cast("bigint").alias("seq"), "step", "source", "phase")


STEPS_SQL = (
    LOG_SQL
    + """, step as (
  select run_id, step, source, arg_max(coalesce(status, case phase when 'started' then 'not_executed' when 'failed' then 'error' else 'has_result' end), seq) as status,
    max(seq) filter (where phase = 'started') as started_at_seq, max(seq) filter (where phase <> 'started') as completed_at_seq, min(seq) as first_seq, arg_max(result_count, seq) as result_count, arg_max(agent_iteration, seq) as agent_iteration
  from log group by run_id, step, source
)"""
)


@C.add("event_fold_steps", f"with {STEPS_SQL} select * from step")
def event_fold_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = events.fold_steps(log(spark, sf_dir))
    return folded.select("run_id", "step", "source", "status", "started_at_seq", "completed_at_seq", "first_seq", "result_count", "agent_iteration")


@C.add(
    "event_fold_run",
    f"""with {STEPS_SQL}, flag as (select run_id, flag, min(seq) as s from log group by all), flags as (select run_id, string_agg(flag, ';' order by s) as flags from flag group by run_id),
    per_run as (select run_id, count(*) as steps, string_agg(step || ':' || source, ';' order by first_seq) as step_order, count(*) filter (where status in ('error', 'timeout', 'unavailable')) as failed_steps from step group by run_id)
    select run_id, max(seq) as last_seq, count(*) as applied, any_value(flags) as flags, max(agent_iteration + 1) as agent_iterations, round(sum(cost_usd), 4) as total_cost_usd, bool_or(step = 'purchase' and phase <> 'started') as finished,
      any_value(steps) as steps, any_value(step_order) as step_order, any_value(failed_steps) as failed_steps from log join flags using (run_id) join per_run using (run_id) group by run_id""",
)
def event_fold_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """purchase stands in for the final answer."""
    whole = log(spark, sf_dir)
    folded = events.fold_runs(whole).drop("finished")
    ended = events.fold_runs(whole.withColumn("step", F.when(F.col("step") == "purchase", "final_answer").otherwise(F.col("step")))).select("run_id", "finished")
    folded = folded.join(ended, "run_id")
    return folded.select("run_id", "last_seq", "applied", F.array_join("flags", ";").alias("flags"), "agent_iterations", F.round("total_cost_usd", 4).alias("total_cost_usd"), "finished", "steps", F.array_join("order", ";").alias("step_order"), "failed_steps")


@C.add("event_replay_after", f"with {LOG_SQL} select run_id, seq, step from log where seq > 40")
def event_replay_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.after(log(spark, sf_dir), 40).select("run_id", F.col("seq").cast("bigint").alias("seq"), "step")


@C.add("event_dedupe", f"with {LOG_SQL} select run_id, seq // 2 as seq, arg_min(step, seq) as step, count(*) as copies from log group by run_id, seq // 2")
def event_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of events share a number; the earlier one wins."""
    paired = log(spark, sf_dir).withColumns({"ts": F.timestamp_micros(F.col("seq")), "seq": F.floor(F.col("seq") / 2)})
    copies = paired.groupBy("run_id", "seq").agg(F.count("*").alias("copies"))
    return events.first_wins(paired).select("run_id", "seq", "step").join(copies, ["run_id", "seq"])


@C.add("run_cost", f"with {LOG_SQL} select run_id, round(sum(cost_usd), 4) as cost_usd from log group by run_id")
def run_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.run_cost(log(spark, sf_dir)).select("run_id", F.round("cost_usd", 4).alias("cost_usd"))


@C.add("failed_sources", f"with {STEPS_SQL} select run_id, step, source, status from step where status in ('error', 'timeout', 'unavailable')")
def failed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.failed_sources(log(spark, sf_dir))


@C.add("event_violations", f"with {LOG_SQL} select run_id, seq from log")
def event_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No event type of the table is a step of a search, so every event is reported."""
    return events.violations(log(spark, sf_dir)).where("rule = 'step'").select("run_id", F.col("seq").cast("bigint").alias("seq"))


BUDGET = Settings(max_iterations=3, max_tool_calls=2, max_seconds=3600, max_cost_usd=0.4)


@C.add(
    "budget_first_violation",
    """with step as (select conv_id as run_id, turn as seq, case when role = 'assistant' then 'llm' else 'tool' end as kind, length(text) / 1000.0 as cost from conversations),
    spent as (select run_id, seq, coalesce(count(*) filter (where kind = 'llm') over w, 0) as i, coalesce(count(*) filter (where kind = 'tool') over w, 0) as t, coalesce(sum(cost) over w, 0) as c from step window w as (partition by run_id order by seq rows between unbounded preceding and 1 preceding)),
    broken as (select *, case when i >= 3 then 'iterations' when t >= 2 then 'tool_calls' when c >= 0.4 then 'cost' end as exhausted from spent)
    select run_id, seq, exhausted from broken where exhausted is not null qualify row_number() over (partition by run_id order by seq) = 1""",
)
def budget_first_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    steps = turns.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), F.when(F.col("role") == "assistant", "llm").otherwise("tool").alias("kind"), F.timestamp_seconds("turn").alias("ts"), (F.length("text") / 1000).alias("cost_usd"))
    return agent.first_violation(steps, BUDGET)


ROUTES = _with_table(Inline({"case_id": "int", "found": "boolean", "kind": "varchar", "overlap": "double", "enabled": "boolean", "available": "boolean"}, (1, True, "full", 1.0, True, True), (2, False, "none", 0.0, True, True), (3, False, "none", 0.2, False, True), (4, False, "none", 0.2, True, False), (5, False, "none", None, True, True), (6, False, "partial", 0.0, True, True)), {'case_id': 'cast(o_orderkey + 100 as int)', 'found': 'o_orderkey % 5 = 0', 'kind': "case when o_custkey % 3 = 0 then 'partial' else 'none' end", 'overlap': 'case when o_custkey % 4 > 0 then cast(o_custkey % 3 as double) / 10 end', 'enabled': 'o_orderkey % 3 > 0', 'available': 'o_orderkey % 4 > 0'}, "orders")


@C.add("agent_route", f"select case_id, case when found then 'answered' when kind = 'none' and overlap = 0 then 'skipped' when not enabled then 'skipped' when not available then 'unavailable' else 'run' end as route from {ROUTES.sql}")
def agent_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ROUTES.frame(spark, sf_dir).select("case_id", agent.route(*[F.col(c) for c in ("found", "kind", "overlap", "enabled", "available")]).alias("route"))


ENDS = _with_table(Inline({"case_id": "int", "local": "varchar", "evidence": "int", "stopped": "varchar", "verdict": "varchar"}, (1, "no_result", 2, "done", "sufficient"), (2, "no_result", 2, "done", "insufficient"), (3, "no_result", 0, "budget_exhausted", None), (4, "has_result", 1, "done", None), (5, "no_result", 0, "model_failed", None), (6, "no_result", 0, "no_tools_available", None), (7, "no_result", 1, "done", None)), {'case_id': 'cast(o_orderkey + 100 as int)', 'local': "case when o_orderkey % 3 = 0 then 'has_result' when o_orderkey % 3 = 1 then 'low_confidence' else 'no_result' end", 'evidence': 'cast(o_custkey % 3 as int)', 'stopped': "case o_custkey % 4 when 0 then 'done' when 1 then 'budget_exhausted' when 2 then 'model_failed' else 'no_tools_available' end", 'verdict': "case when o_orderkey % 5 = 0 then 'insufficient' when o_orderkey % 5 = 1 then 'sufficient' end"}, "orders")


@C.add("agent_outcome", f"select case_id, case when evidence > 0 then 'has_result' when stopped = 'model_failed' then 'error' when stopped = 'no_tools_available' then 'skipped' when stopped = 'budget_exhausted' then 'low_confidence' else 'no_result' end as agent_status, case when local = 'no_result' and evidence > 0 and coalesce(verdict, '') <> 'insufficient' then 'low_confidence' else local end as final_status from {ENDS.sql}")
def agent_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.when(F.col("evidence") > 0, F.array(F.lit("model_has_result"))).otherwise(F.array().cast("array<string>"))
    return ENDS.frame(spark, sf_dir).select("case_id", agent.agent_status(F.col("evidence"), F.col("stopped")).alias("agent_status"), agent.final_status(F.col("local"), flags, F.col("evidence"), F.col("verdict")).alias("final_status"))


# Input rows are documents; results of a first pass exist for those of even length, settled where the language is English.
RESULT_SQL = "result as (select source as job_id, doc_id as row_index, case when lang = 'en' then 'has_result' when lang = 'fr' then 'skipped' else 'error' end as status, n_chars as finished_at from documents where n_chars % 2 = 0)"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "documents").where("n_chars % 2 = 0")
    status = F.when(F.col("lang") == "en", "has_result").when(F.col("lang") == "fr", "skipped").otherwise("error")
    return done.select(F.col("source").alias("job_id"), F.col("doc_id").alias("row_index"), status.alias("status"), F.col("n_chars").alias("finished_at"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("job_id"), F.col("doc_id").alias("row_index"))


@C.add("batch_pending_none", f"with {RESULT_SQL} select source as job_id, doc_id as row_index from documents where doc_id not in (select row_index from result)")
def batch_pending_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.pending(_rows(spark, sf_dir), _results(spark, sf_dir), "none")


@C.add("batch_pending_unresolved", f"with {RESULT_SQL} select source as job_id, doc_id as row_index from documents where doc_id not in (select row_index from result where status in ('has_result', 'skipped'))")
def batch_pending_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.pending(_rows(spark, sf_dir), _results(spark, sf_dir), "unresolved")


@C.add("batch_pending_all", "select source as job_id, doc_id as row_index from documents")
def batch_pending_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.pending(_rows(spark, sf_dir), _results(spark, sf_dir), "all")


@C.add("batch_status_counts", f"with {RESULT_SQL} select job_id, status, count(*) as n from result group by all")
def batch_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.status_counts(_results(spark, sf_dir).unionByName(_results(spark, sf_dir).withColumns({"status": F.lit("timeout"), "finished_at": F.lit(-1).cast("bigint")})))


@C.add("batch_export_left_join", f"with {RESULT_SQL} select doc_id as row_index, coalesce(status, 'not_executed') as han_status, case when status = 'has_result' then lang end as han_title, case when status is null or status <> 'has_result' then 'none' else 'full' end as han_match_kind, case when status = 'has_result' then left(text, 20) end as han_matched_text from documents left join result on doc_id = row_index")
def batch_export_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    evidence = F.expr("array(named_struct('title', lang, 'content', text, 'span_start', 0, 'span_end', 20))")
    found = _results(spark, sf_dir).join(documents, F.col("row_index") == F.col("doc_id")).select("row_index", F.struct("status", F.array(F.lit("exact_full_match")).alias("flags"), evidence.alias("evidence")).alias("o"))
    outcome = F.from_json(F.to_json("o"), batch.OUTCOME)
    rows = documents.select(F.col("doc_id").alias("row_index"), F.lit("").alias("original"))
    return batch.export(rows, found.select("row_index", outcome.alias("outcome")), ["status", "title", "match_kind", "matched_text"]).drop("original")


KINDS = _with_table(Inline({"case_id": "int", "status": "varchar", "flags": "varchar", "has_top": "boolean", "dataset": "varchar"}, (1, "has_result", "exact_full_match", True, None), (2, "has_result", "exact_ambiguous;exact_full_match", True, "user-added"), (3, "low_confidence", "", True, "agent-proposed"), (4, "low_confidence", "", False, "other"), (5, "no_result", "exact_full_match", True, None), (6, "has_result", "exact_partial_match", True, "user-added")), {'case_id': 'cast(o_orderkey + 100 as int)', 'status': "case o_custkey % 3 when 0 then 'has_result' when 1 then 'low_confidence' else 'no_result' end", 'flags': "case o_orderkey % 5 when 0 then 'exact_ambiguous;exact_full_match' when 1 then 'exact_full_match' when 2 then 'exact_partial_match' when 3 then 'other' else '' end", 'has_top': 'o_orderkey % 2 = 0', 'dataset': "case o_orderkey % 3 when 0 then 'user-added' when 1 then 'agent-proposed' end"}, "orders")


@C.add("match_kind", f"select case_id, case when status not in ('has_result', 'low_confidence') then 'none' when contains(flags, 'exact_ambiguous') then 'ambiguous' when contains(flags, 'exact_full_match') then 'full' when contains(flags, 'exact_partial_match') or has_top then 'partial' else 'none' end as match_kind, case dataset when 'user-added' then 'user' when 'agent-proposed' then 'agent' else 'no' end as origin from {KINDS.sql}")
def match_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KINDS.frame(spark, sf_dir).select("case_id", batch.match_kind(F.col("status"), F.split("flags", ";"), F.col("has_top")).alias("match_kind"), batch.addition_origin(F.col("dataset")).alias("origin"))


@C.add("alternatives_string", "with ranked as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_returnflag, l_linestatus, l_discount) as k, l_shipdate, l_linestatus, l_returnflag, l_discount from lineitem) select l_orderkey, string_agg(l_returnflag || ' — ' || l_linestatus || ' (' || regexp_replace(cast(floor(l_discount * 1000 + 0.5) / 1000 as varchar), '\\.0$', '') || ')', '; ' order by k) as alternatives from ranked where k between 2 and 4 group by l_orderkey")
def alternatives_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_returnflag").alias("title"), F.col("l_linestatus").alias("author"), F.col("l_discount").alias("score"), F.lit(None).cast("double").alias("rerank_score")))).alias("e"))
    return listed.select("l_orderkey", batch.alternatives(F.col("e")).alias("alternatives")).where("alternatives is not null")


RATIO = "length(regexp_replace({0}, '[^\\p{{L}}]', '', 'g'))"


@C.add(
    "column_profile",
    """with cell as (select 'lang' as name, lang as value from documents union all select 'source', source from documents union all select 'text', trim(text) from documents)
    select name, 0.0::double as cjk_ratio, count(*) filter (where value <> '') / count(*) as filled, round(avg(length(value)), 6) as mean_length, 0.0::double as score from cell group by name""",
)
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No Han text in the table: every ratio is 0."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_index"), F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("name"), F.trim(n).alias("value")) for i, n in enumerate(("lang", "source", "text"))])).alias("c")).select("row_index", "c.*")
    return columns.profile(rows).select("name", "cjk_ratio", "filled", F.round("mean_length", 6).alias("mean_length"), "score")


_CELLS_SQL = f"(select doc_id as row_index, o as ord, ['id', 'poem', 'note'][o + 1] as name, trim(coalesce(case o when 0 then cast(doc_id as varchar) when 1 then {HAN_OF.format('text')} else {HAN_OF.format('source')} end, '')) as value from documents, (select unnest([0, 1, 2]) as o))"


@C.add(
    "column_suggest",
    f"""with filled as (select ord, name, row_index, value, length(regexp_replace(regexp_replace(value, '[\\s\\pP\\pS]', '', 'g'), '[^\\p{{Han}}]', '', 'g')) / nullif(length(regexp_replace(value, '[\\s\\pP\\pS]', '', 'g')), 0) as ratio from {_CELLS_SQL}),
    prof as (select ord, name, coalesce(avg(coalesce(ratio, 0)) filter (where value <> ''), 0) as r, count(*) filter (where value <> '') / count(*) as f, coalesce(avg(length(value)) filter (where value <> ''), 0) as m from filled group by all),
    fit as (select name, r * f * ln(1 + m) as s, row_number() over (order by r * f * ln(1 + m) desc, ord) as k from prof where r >= 0.5 and f >= 0.5),
    best as (select max(s) filter (where k = 1) as a, max(s) filter (where k = 2) as b, max(name) filter (where k = 1) as name from fit)
    select case when a is not null and not coalesce(a < b * 1.5, false) then name end as suggested, case when a is null then 'no_cjk' when a < b * 1.5 then 'ambiguous' end as abstain_reason from best""",
)
def column_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which column of documents holds the poems, their letters in Han: numbers, texts or short notes."""
    values = (F.col("doc_id").cast("string"), in_han(F.col("text")), in_han(F.col("source")))
    each = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("name"), F.trim(F.coalesce(v, F.lit(""))).alias("value")) for i, (n, v) in enumerate(zip(("id", "poem", "note"), values))])
    return columns.suggest(columns.profile(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_index"), F.explode(each).alias("c")).select("row_index", "c.*")))


NEW = _with_table(Inline({"row_index": "int", "title": "varchar", "author": "varchar", "text": "varchar"}, (1, "旅夜書懷", "杜甫", "細草微風岸危檣獨夜舟"), (2, "", "杜甫", "細草"), (3, None, None, None), (4, "x" * 201, "y", "星垂平野闊"), (5, "t", "a", "abc"), (6, "旅夜書懷", "杜甫", "細草微風岸，危檣獨夜舟。"), (7, "長", "人", "天" * 4001)), {'row_index': 'cast(o_orderkey + 100 as int)', 'title': 'case when o_custkey % 3 > 0 then o_orderpriority end', 'author': "case when o_custkey % 4 > 0 then o_orderstatus else '  ' end", 'text': "repeat('細草x', cast(o_orderkey % 4 as int))"}, "orders")
_HAN = "length(regexp_replace(trim(coalesce(text, '')), '[^\\p{Han}]', '', 'g'))"


@C.add(
    "addition_validate",
    f"""select row_index, concat_ws(';', case when trim(coalesce(title, '')) = '' then 'title' end, case when trim(coalesce(author, '')) = '' then 'author' end, case when trim(coalesce(text, '')) = '' then 'text' end,
    case when trim(coalesce(text, '')) <> '' and {_HAN} < 4 then 'text_han' when trim(coalesce(text, '')) <> '' and {_HAN} > 4000 then 'text_long' end, case when length(trim(coalesce(title, ''))) > 200 then 'title_long' end) as missing from {NEW.sql}""",
)
def addition_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NEW.frame(spark, sf_dir).select("row_index", F.array_join(additions.refusals(F.col("title"), F.col("author"), F.col("text")), ";").alias("missing"))


@C.add("addition_outcomes", f"with poem as (select doc_id, sha256(lang || chr(10) || source || chr(10) || {MATCH.format('text')}) as h from documents), marked as (select h, row_number() over (partition by h order by doc_id) as k, h in (select h from poem where doc_id % 2 = 0) as held, doc_id from poem) select case when (held and doc_id % 2 <> 0) or k > 1 then 'duplicate' else 'added' end as result, count(*) as n from marked group by 1")
def addition_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as additions to a corpus that holds those of even id; those themselves count as new."""
    frame = table(spark, sf_dir, "documents").withColumn("content_hash", keys.addition_hash(F.col("lang"), F.col("source"), text.match_form(F.col("text"), LETTERS)))
    held = frame.where("doc_id % 2 = 0").select("content_hash", F.lit(True).alias("held")).distinct()
    nth = F.row_number().over(Window.partitionBy("content_hash").orderBy("doc_id"))
    result = F.when((F.coalesce("held", F.lit(False)) & (F.col("doc_id") % 2 != 0)) | (nth > 1), "duplicate").otherwise("added")
    return additions.tally(frame.join(held, "content_hash", "left").withColumn("result", result))


PROPOSALS = _with_table(Inline({"case_id": "int", "verdict": "varchar", "nothing": "boolean", "url": "varchar", "ok": "boolean", "dup": "boolean"}, (1, "sufficient", True, "u1", True, False), (2, "conflicting", True, "u1", True, False), (3, "sufficient", False, "u1", True, False), (4, "sufficient", True, "u9", True, False), (5, "sufficient", True, None, True, False), (6, "sufficient", True, "u1", False, True), (7, "sufficient", True, "u1", True, True), (8, None, True, "u1", True, False)), {'case_id': 'cast(o_orderkey + 100 as int)', 'verdict': "case o_custkey % 3 when 0 then 'sufficient' when 1 then 'conflicting' end", 'nothing': 'o_orderkey % 3 > 0', 'url': "case o_orderkey % 4 when 0 then 'u1' when 1 then 'u2' when 2 then 'u3' end", 'ok': 'o_custkey % 4 > 0', 'dup': 'o_orderkey % 5 = 0'}, "orders")


@C.add("proposal_gates", f"select case_id, case when coalesce(verdict, '') <> 'sufficient' then 'verdict' when not nothing then 'local_answered' when url is null or url not in ('u1', 'u2') then 'url_not_retrieved' when not ok then 'rules' when dup then 'duplicate' end as gate from {PROPOSALS.sql}")
def proposal_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = F.when(F.col("ok"), F.array().cast("array<string>")).otherwise(F.array(F.lit("title")))
    return PROPOSALS.frame(spark, sf_dir).select("case_id", additions.proposal_gate(F.col("verdict"), F.col("nothing"), F.col("url"), F.array(F.lit("u1"), F.lit("u2")), missing, F.col("dup")).alias("gate"))


@C.add("addition_counts", "select o_orderstatus as status, o_orderpriority as origin, count(*) as n from orders group by all")
def addition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additions.counts(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("origin")))


@C.add("corpus_counts", "select count(*) as total, count(*) filter (where lang = 'fr') as user_added, count(*) filter (where lang = 'de') as agent_added from documents where length(regexp_replace(text, '[^\\p{L}]', '', 'g')) > 0")
def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """French stands for what users added, German for what agents proposed."""
    named = poems(spark, sf_dir).withColumn("dataset", F.when(F.col("dataset") == "fr", "user-added").when(F.col("dataset") == "de", "agent-proposed").otherwise(F.col("dataset")))
    return additions.corpus_counts(named)


RANKS_SQL = "with ranked as (select o_orderpriority as damage, case when o_custkey % 13 < 12 then 1 + o_custkey % 13 end as rank, o_totalprice as latency_ms from orders)"


def _measure(key: str) -> str:
    return f"select {key} as damage, count(*) as n, round(avg(case when rank = 1 then 1.0 else 0 end), 6) as recall_1, round(avg(case when rank <= 10 then 1.0 else 0 end), 6) as recall_10, round(avg(coalesce(1.0 / rank, 0)), 6) as mrr, list_sort(list(latency_ms))[1 + floor(count(*) / 2)::bigint] as median_ms from ranked group by 1"


@C.add("eval_recall_mrr", f"{RANKS_SQL} {_measure('damage')} union all {_measure(chr(39) + 'overall' + chr(39))}")
def eval_recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("damage"), F.when(F.col("o_custkey") % 13 < 12, 1 + F.col("o_custkey") % 13).alias("rank"), F.col("o_totalprice").alias("latency_ms"))
    return evaluate.metrics(ranked).select("damage", "n", *[F.round(c, 6).alias(c) for c in ("recall_1", "recall_10", "mrr")], "median_ms")


@C.add("overlap_percentiles", "with s as (select list_sort(list(l_extendedprice)) as v, count(*) as n from lineitem), p as (select unnest([0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]::double[]) as share) select share, v[1 + least(n - 1, floor(n * share)::bigint)] as value from s, p")
def overlap_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.percentiles(table(spark, sf_dir, "lineitem"), "l_extendedprice")


@C.add("floor_rejections", "with f as (select unnest([0.01, 0.03, 0.05, 0.08]::double[]) as floor) select floor, count(*) filter (where l_discount < floor) as rejected, count(*) as n from lineitem, f group by floor")
def floor_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.rejections(table(spark, sf_dir, "lineitem"), "l_discount", (0.01, 0.03, 0.05, 0.08))


@C.add("eval_sample", "select p_partkey as work_id from part order by md5(cast(p_partkey as varchar)), p_partkey limit 40")
def eval_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.sample(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("work_id")), 40)


@C.add("eval_damage")
def eval_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every damage of every document's clauses; the kinds are tested one by one."""
    works = poems(spark, sf_dir).select(F.col("poem_id").alias("work_id"), text.corpus_lines(F.col("text_display"), LETTERS).alias("lines"))
    return evaluate.cases(works)


@C.add("html_links", "select page_id, cast(len(l) as bigint) as n_links, l[1] as first_href from (select page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*href\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1) as l from pages) where len(l) > 0")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.links(table(spark, sf_dir, "pages"))
    return found.groupBy("page_id").agg(F.count("*").alias("n_links"), F.min_by("href", "place").alias("first_href"))


@C.add("html_text", "select page_id, trim(regexp_replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) as text from pages")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.stripped(F.col("html")).alias("text"))


# Pages that begin with a poem whose lines are the parts of their url, pages that say that nothing was found, and others.
_SHOWN_URL = "trim(regexp_replace(regexp_replace(url, '[<>]', '', 'g'), '\\s+', ' ', 'g'))"


def _poem_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.replace(F.regexp_replace("url", "[<>]", ""), F.lit("&"), F.lit("&amp;"))
    lines = F.array_join(F.transform(F.split(shown, "/"), lambda x: F.concat(F.lit("<div class='poemSentence'>"), x, F.lit("<i>&nbsp;</i></div>"))), "\n")
    poem = F.concat(
        F.format_string("<div id='poem_title_%d' class='x'><a href='/p/%d'>", "page_id", "page_id"), shown, F.lit("</a><span class='inlineComment1'>page · </span><a href='javascript:x()'>"),
        F.concat(F.lit("author "), F.col("page_id") % 5), F.format_string("</a></div><div class='poemContent' id='poem_content_%d'>", "page_id"), lines, F.lit("</div>"),
    )
    html_ = F.when(F.col("page_id") % 3 == 0, F.concat(poem, "html")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("<p>没有找到</p>"), "html")).otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", html_.alias("html"))


@C.add("html_poems", f"""select page_id, 0 as place, cast(page_id as varchar) as id, {_SHOWN_URL} as title, 'author ' || page_id % 5 as author, 'page' as dynasty,
    list_filter(list_transform(string_split({_SHOWN_URL}, '/'), lambda x: trim(x)), lambda x: x <> '') as lines, '{html.SITE}/p/' || page_id as url from pages where page_id % 3 = 0 and url is not null and html is not null""")
def html_poems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.poems(_poem_pages(spark, sf_dir))


@C.add("html_outcomes", "select page_id, case when page_id % 3 = 0 and url is not null and html is not null then 'has_result' when page_id % 3 = 1 and html is not null then 'no_result' else 'error' end as status, case when page_id % 3 = 0 and url is not null and html is not null then 1 else 0 end as n from pages")
def html_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.outcomes(_poem_pages(spark, sf_dir)).select("page_id", "status", F.col("n").cast("int").alias("n"))


@C.add("addition_origins", "select o_orderkey as row_index, case o_custkey % 3 when 0 then 'user' when 1 then 'agent' else 'no' end as origin from orders")
def addition_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    dataset = F.when(F.col("o_custkey") % 3 == 0, "user-added").when(F.col("o_custkey") % 3 == 1, "agent-proposed").otherwise(F.nullif("o_orderstatus", F.lit("O")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_index"), batch.addition_origin(dataset).alias("origin"))


USAGE = _with_table(Inline({"case_id": "int", "model": "varchar", "tokens_in": "bigint", "tokens_out": "bigint", "cached": "bigint"}, (1, "a", 1_000_000, 500_000, 0), (2, "a", 1000, 10, 5000), (3, "b", 1000, 10, 400), (4, "c", 10, 10, 0), (5, "a", None, None, None), (6, "b", 100, 100, -5), (7, "a", 2000, 0, None)), {'case_id': 'cast(o_orderkey + 100 as int)', 'model': "case o_orderkey % 3 when 0 then 'a' when 1 then 'b' else 'c' end", 'tokens_in': 'cast(case when o_custkey % 7 > 0 then o_custkey end as bigint)', 'tokens_out': 'cast(o_orderkey % 1000 as bigint)', 'cached': 'cast(case when o_custkey % 5 > 0 then o_custkey % 400 - 20 end as bigint)'}, "orders")
PRICES = Inline({"model": "varchar", "rate_in": "double", "rate_out": "double", "rate_cached": "double"}, ("a", 3.0, 15.0, 0.3), ("b", 1.0, 2.0, None))


@C.add("cost_estimate", f"with u as (select *, least(greatest(coalesce(cached, 0), 0), tokens_in) as held from {USAGE.sql}) select case_id, round((tokens_in - held) / 1e6 * rate_in + held / 1e6 * coalesce(rate_cached, rate_in) + tokens_out / 1e6 * rate_out, 9) as cost_usd from u left join {PRICES.sql} using (model)")
def cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = USAGE.frame(spark, sf_dir).join(F.broadcast(PRICES.frame(spark)), "model", "left")
    return met.select("case_id", F.round(numbers.token_cost(*[F.col(c) for c in ("tokens_in", "tokens_out", "cached", "rate_in", "rate_out", "rate_cached")]), 9).alias("cost_usd"))


SIZES = _with_table(Inline({"rows": "bigint", "agent": "boolean"}, (0, True), (1, False), (100, True), (5425, True), (5425, False), (-3, True), (1_000_000, True)), {'rows': 'cast(o_custkey * 37 + o_orderkey as bigint)', 'agent': 'o_orderkey % 2 = 0'}, "orders")


@C.add(
    "batch_estimate",
    f"""with e as (select greatest(rows, 0) as n, agent, rows as given from {SIZES.sql}), s as (select given, agent, n, ceil(n * case when agent then 0.3::double else 0 end)::bigint as agent_rows from e),
    t as (select *, floor((n * 0.75 + agent_rows * 45) / 4 + 0.5)::bigint as seconds from s)
    select given, agent, n as estimated_rows, agent_rows, seconds, case when seconds < 90 then seconds when seconds < 5400 then floor(seconds / 60 * 10 + 0.5) / 10 when seconds < 172800 then floor(seconds / 3600 * 10 + 0.5) / 10 else floor(seconds / 86400 * 10 + 0.5) / 10 end as value,
      case when seconds < 90 then 'second' when seconds < 5400 then 'minute' when seconds < 172800 then 'hour' else 'day' end as unit from t""",
)
def batch_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = SIZES.frame(spark, sf_dir).select(F.col("rows").alias("given"), "agent", numbers.estimate(F.col("rows"), F.col("agent")).alias("e"))
    return found.select("given", "agent", F.col("e.rows").alias("estimated_rows"), "e.agent_rows", "e.seconds", numbers.human_seconds(F.col("e.seconds")).alias("h")).select("given", "agent", "estimated_rows", "agent_rows", "seconds", "h.value", "h.unit")


@C.add("paging_top50", "select o_orderkey as job_id, o_orderdate as created_at from orders order by o_orderdate desc, o_orderkey limit 50 offset 25")
def paging_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.newest(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created_at")), 50, 25)


@C.add("semi_in_having", "select o_orderkey, o_totalprice from orders where o_orderkey in (select l_orderkey from lineitem group by l_orderkey having count(distinct l_returnflag) = 1 and min(l_linenumber) = 1 and count(*) >= 5)")
def semi_in_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    regular = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_returnflag").alias("kinds"), F.min("l_linenumber").alias("first"), F.count("*").alias("n")).where("kinds = 1 and first = 1 and n >= 5")
    return table(spark, sf_dir, "orders").join(regular, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_totalprice")


@C.add("anti_not_exists", "select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority like '1%')")
def anti_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority like '1%'")
    return table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@C.add("missing_names", "select string_agg(n_name, ', ' order by n_name) as missing, count(*) as n from nation where not exists (select 1 from supplier where s_nationkey = n_nationkey)")
def missing_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    lacking = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left_anti")
    return lacking.agg(F.nullif(F.array_join(F.array_sort(F.collect_list("n_name")), ", "), F.lit("")).alias("missing"), F.count("*").alias("n"))


@C.add("lateral_topk", "select c_custkey, o_orderkey, k from (select c_custkey, o_orderkey, row_number() over (partition by c_custkey order by o_totalprice desc, o_orderkey) as k from customer join orders on c_custkey = o_custkey) where k <= 3")
def lateral_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = Window.partitionBy("c_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    met = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return met.select("c_custkey", "o_orderkey", F.row_number().over(best).cast("bigint").alias("k")).where("k <= 3")


@C.add("left_author_dim", "select s_suppkey, s_name, n_name, r_name from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def left_author_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return table(spark, sf_dir, "supplier").join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "s_name", "n_name", "r_name")


@C.add("calibration_join", "select l_orderkey, c_custkey, n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where l_returnflag like 'R%' group by all")
def calibration_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = table(spark, sf_dir, "lineitem").where("l_returnflag like 'R%'").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return met.groupBy("l_orderkey", "c_custkey", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"))


@C.add("json_predicate", "select event_id, cast(json_extract_string(props, '$.k') as int) as k from events where event_type like 'c%' and cast(json_extract_string(props, '$.k') as int) > 50")
def json_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").where(F.col("event_type").like("c%") & (k > 50)).select("event_id", k.alias("k"))


@C.add("jobs_with_counts", f"with {RESULT_SQL}, job as (select distinct source as job_id from documents) select job_id, string_agg(status || ':' || n, ';' order by status) as counts from job join (select job_id, status, count(*) as n from result group by all) using (job_id) group by job_id")
def jobs_with_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = batch.with_counts(_rows(spark, sf_dir).select("job_id").distinct(), _results(spark, sf_dir)).where("cardinality(counts) > 0")
    return met.select("job_id", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ";").alias("counts"))


NAMES = _with_table(Inline({"requested": "varchar", "served": "varchar"}, ("big-model", "big-model-2024"), ("big-model", "Big Model"), ("big-model", "small"), ("a.b", "ab-c"), ("x", None)), {'requested': 'p_brand', 'served': "case when p_partkey % 3 = 0 then p_brand || '-' || p_size when p_partkey % 3 = 1 then p_type end"}, "part")


@C.add("model_substituted", f"select requested, served, coalesce(not (starts_with(a, b) or starts_with(b, a)), false) as substituted from (select *, lower(regexp_replace(requested, '[^A-Za-z0-9]', '', 'g')) as a, lower(regexp_replace(served, '[^A-Za-z0-9]', '', 'g')) as b from {NAMES.sql})")
def model_substituted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NAMES.frame(spark, sf_dir).select("requested", "served", text.substituted(F.col("requested"), F.col("served")).alias("substituted"))


@C.add("event_iso", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as iso from events")
def event_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", numbers.iso_milliseconds(F.col("ts")).alias("iso"))


@C.add("tool_calls_assembled", "select conv_id as response_id, cast(0 as int) as \"index\", string_agg(text, '' order by turn) as raw_arguments from conversations group by conv_id")
def tool_calls_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("response_id"), F.col("turn").alias("seq"), F.lit(0).alias("index"), F.col("role").alias("name"), F.col("text").alias("arguments"))
    return agent.assembled(chunks).select("response_id", "index", "raw_arguments")
