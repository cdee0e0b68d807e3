"""Batch jobs: what is left to run, results with the last writer winning, and the rows of an export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions import text
from lacuna.functions.numbers import rounded
from lacuna.functions.records import FORM_LABELS_VI, form_label
from lacuna.operators.events import is_settled

# The columns of an export in order, with their group and whether they are in by default.
EXPORT_COLUMNS = (
    ("status", "verdict", True), ("match_kind", "verdict", True), ("confidence", "verdict", True), ("flags", "verdict", True),
    ("llm_verdict", "verdict", True), ("llm_notes", "verdict", False), ("title", "identity", True), ("author", "identity", True),
    ("dynasty", "identity", True), ("work_id", "identity", True), ("edition", "identity", False), ("matched_text", "text", True),
    ("input_normalized", "text", False), ("colophon", "text", False), ("colophon_date", "text", False), ("full_text", "text", False),
    ("form", "verification", False), ("form_label", "verification", True), ("verify_form", "verification", False),
    ("verify_rhyme", "verification", False), ("verify_tone", "verification", False), ("source", "provenance", True),
    ("added", "provenance", True), ("added_source", "provenance", False), ("retrieval_method", "provenance", False),
    ("dataset", "provenance", False), ("commit_sha", "provenance", False), ("url", "provenance", False), ("run_id", "audit", True),
    ("reordered", "audit", False), ("reading", "audit", False), ("cost_usd", "audit", False), ("latency_ms", "audit", False),
    ("model", "audit", False), ("alternatives", "raw", False), ("json", "raw", False),
)
LOCKED, PREFIX, ANSWERING, OWN_DATASET = ("status",), "han_", ("has_result", "low_confidence"), "chinese-poetry"

OUTCOME = """run_id string, status string, confidence double, flags array<string>,
evidence array<struct<id string, source string, retrieval_method string, work_id string, title string, author string, dynasty string, edition string,
dataset string, file string, commit_sha string, url string, content string, span_start int, span_end int, score double, rerank_score double>>,
colophon array<string>, colophon_date string, form string, verify_form string, verify_rhyme string, verify_tone string, llm_verdict string, llm_notes string,
normalized string, reading string, cost_usd double, latency_ms bigint, model string"""


def resolve_columns(requested: list[str] | None) -> list[str]:
    """Requested keys in the order of the registry, with those that can't be left out; unknown ones drop out."""
    wanted = {k for k, _, default in EXPORT_COLUMNS if default} if requested is None else set(requested)
    return [k for k, _, _ in EXPORT_COLUMNS if k in wanted or k in LOCKED]


def header(key: str) -> str:
    return PREFIX + key


def latest(results: DataFrame) -> DataFrame:
    """One result for each (job_id, row_index), the last to finish."""
    values = [c for c in results.columns if c not in ("job_id", "row_index")]
    return results.groupBy("job_id", "row_index").agg(F.max_by(F.struct(*values), F.struct("finished_at", "status")).alias("v")).select("job_id", "row_index", "v.*")


def pending(rows: DataFrame, results: DataFrame, mode: str = "none") -> DataFrame:
    """Input rows still to run: those without a result (none), without a settled one (unresolved), or all."""
    if mode == "all":
        return rows
    if mode not in ("none", "unresolved"):
        raise ValueError(f"no such mode: {mode}")
    done = latest(results) if mode == "none" else latest(results).where(is_settled(F.col("status")))
    return rows.join(done.select("job_id", "row_index"), ["job_id", "row_index"], "left_anti")


def row_status(parse_error: Column, cell: Column, searched: Column) -> Column:
    """error for a row that couldn't be parsed, skipped for an empty cell, else what the search said."""
    return F.when(parse_error.isNotNull(), "error").when(F.trim(F.coalesce(cell, F.lit(""))) == "", "skipped").otherwise(F.coalesce(searched, F.lit("error")))


def match_kind(status: Column, flags: Column, has_top: Column) -> Column:
    has = lambda f: F.array_contains(F.coalesce(flags, F.array().cast("array<string>")), f)
    return (
        F.when(~status.isin(*ANSWERING), "none").when(has("exact_ambiguous"), "ambiguous").when(has("exact_full_match"), "full").when(has("exact_partial_match"), "partial").when(has_top, "partial").otherwise("none")
    )


def addition_origin(dataset: Column) -> Column:
    return F.when(dataset == "user-added", "user").when(dataset == "agent-proposed", "agent").otherwise("no")


def alternatives(evidence: Column) -> Column:
    """Ranks 2 to 4 in one text, or null."""
    named = F.transform(F.slice(evidence, 2, 3), lambda e: F.concat(F.coalesce(e["title"], F.lit("?")), F.lit(" — "), F.coalesce(e["author"], F.lit("?")), F.lit(" ("), F.regexp_replace(rounded(F.coalesce(e["rerank_score"], e["score"])).cast("string"), r"\.0$", ""), F.lit(")")))
    return F.when(F.size(evidence) > 1, F.array_join(named, "; "))


def export(rows: DataFrame, results: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """rows (row_index, original) with an export column for each key; results (row_index, outcome). Rows without result weren't executed."""
    met = rows.join(results.select("row_index", "outcome"), "row_index", "left")
    o = F.col("outcome")
    status = F.coalesce(o["status"], F.lit("not_executed"))
    answers = status.isin(*ANSWERING)
    top = F.when(answers, F.get(o["evidence"], F.lit(0)))
    shown = lambda value: F.when(answers, value)
    own = F.coalesce(top["dataset"] == OWN_DATASET, F.lit(True))
    values = {
        "status": status,
        "match_kind": match_kind(status, o["flags"], top.isNotNull()),
        "confidence": rounded(o["confidence"]),
        "flags": F.nullif(F.array_join(o["flags"], ";"), F.lit("")),
        "llm_verdict": o["llm_verdict"],
        "llm_notes": F.nullif(o["llm_notes"], F.lit("")),
        "matched_text": text.matched_text(top["content"], top["span_start"], top["span_end"]),
        "input_normalized": o["normalized"],
        "colophon": F.array_join(o["colophon"], " / "),
        "colophon_date": o["colophon_date"],
        "full_text": top["content"],
        "form": shown(o["form"]),
        "form_label": shown(form_label(o["form"], FORM_LABELS_VI)),
        "verify_form": shown(o["verify_form"]),
        "verify_rhyme": shown(o["verify_rhyme"]),
        "verify_tone": shown(o["verify_tone"]),
        "added": shown(addition_origin(top["dataset"])),
        "added_source": F.when(~own, F.coalesce(top["url"], top["file"])),
        "run_id": o["run_id"],
        "reordered": F.array_contains(o["flags"], "input_reordered"),
        "reading": o["reading"],
        "cost_usd": o["cost_usd"],
        "latency_ms": o["latency_ms"],
        "model": o["model"],
        "alternatives": shown(alternatives(o["evidence"])),
        "json": F.to_json(o),
    }
    plain = ("title", "author", "dynasty", "work_id", "edition", "source", "retrieval_method", "dataset", "commit_sha", "url")
    values |= {k: top[k] for k in plain}
    return met.select("row_index", "original", *[values[k].alias(header(k)) for k in resolve_columns(columns)])


def status_counts(results: DataFrame) -> DataFrame:
    return latest(results).groupBy("job_id", "status").agg(F.count("*").alias("n"))


def with_counts(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """jobs with a map of statuses to numbers of rows; a job without results has an empty one."""
    counted = status_counts(results.join(jobs.select("job_id"), "job_id", "left_semi")).groupBy("job_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("counts"))
    return jobs.join(counted, "job_id", "left").withColumn("counts", F.coalesce("counts", F.create_map().cast("map<string,bigint>")))


def newest(jobs: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), "job_id").offset(offset).limit(limit)


# The life of a job.
TRANSITIONS = {"scanned": ("running",), "running": ("done", "cancelled", "failed", "interrupted"), "done": ("running",), "cancelled": ("running",), "failed": ("running",), "interrupted": ("running",)}


class JobError(ValueError):
    """A request that a job's state doesn't allow; code as an HTTP status."""

    def __init__(self, code: int, message: str) -> None:
        super().__init__(message)
        self.code = code


def start(status: str | None, column: str | None, left: int) -> str:
    """The status of a job that is started again, or why it can't be."""
    if status is None:
        raise JobError(404, "no such job")
    if status == "running":
        raise JobError(409, "the job is running")
    if not column:
        raise JobError(400, "no column was chosen")
    if left == 0:
        raise JobError(409, "no row is left to run")
    return "running"


def moved(jobs: DataFrame) -> DataFrame:
    """jobs (job_id, status, wanted) in the status they want, where their life allows it; `refused` says where it doesn't."""
    allowed = F.create_map(*[x for a, after in TRANSITIONS.items() for x in (F.lit(a), F.array(*map(F.lit, after)))])
    free = F.coalesce(F.array_contains(F.try_element_at(allowed, F.col("status")), F.col("wanted")), F.lit(False))
    return jobs.withColumns({"status": F.when(free, F.col("wanted")).otherwise(F.col("status")), "refused": ~free}).drop("wanted")


def interrupted(jobs: DataFrame) -> DataFrame:
    """Jobs after a restart: what ran is interrupted."""
    return jobs.withColumn("status", F.when(F.col("status") == "running", "interrupted").otherwise(F.col("status")))


def orphans(files: DataFrame, jobs: DataFrame) -> DataFrame:
    """files (path, job_id, bytes) of no known job."""
    return files.join(jobs.select("job_id"), "job_id", "left_anti")


def capped_spend(rows: DataFrame, cap: float) -> DataFrame:
    """rows (row_index, cost_usd): whether the agent was still allowed before each row, by spend so far."""
    before = Window.orderBy("row_index").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("agent_allowed", F.coalesce(F.sum("cost_usd").over(before), F.lit(0.0)) < cap)
