"""The engine's entry points as functions: search, batches, additions and health, over one corpus."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.config import Settings, as_dict, override
from lacuna.functions import numbers, text
from lacuna.operators import additions, agent, batch, columns, corpus, events, exact, hybrid, service, vectors
from lacuna.sources import jobs, jsonl, segments, sniff, tables, xlsx
from lacuna.storage import checkpointed

# Bounds of a query, rows that suggest a column, texts of a call.
MOST_QUERY, SCANNED_ROWS, MOST_TEXTS, MOST_DOCUMENTS = 2000, 200, 512, 200


class RequestError(ValueError):
    """A request that can't be served; code as an HTTP status."""

    def __init__(self, code: int, message: str) -> None:
        super().__init__(message)
        self.code = code


@dataclass
class Engine:
    """One corpus with its settings. Vectors and a scorer are optional: without them their sources are unavailable."""

    spark: SparkSession
    library: corpus.Corpus
    settings: Settings = Settings()
    points: DataFrame | vectors.Coded | None = None
    meta: Mapping[str, Any] | None = None
    scorer: hybrid.Scorer | None = None
    index: corpus.Index | None = None
    index_folder: str | None = None
    web: agent.PageCache | None = None
    ask: Callable[[str], str] | None = None

    def indexed(self, folder: str, follow: bool = False) -> Engine:
        """This engine over stored postings, which are written where the folder has none. Those of another profile or
        corpus are refused; with follow, what has changed in the corpus since is written and hidden."""
        store = segments.Segments(self.spark, folder, self.library.profile)
        if follow or not store.generation()[0]:
            index = store.follow(self.library.poems, self.library.lines)
        else:
            index = store.read(self.library.poems)
        return replace(self, index=index, index_folder=folder)

    def over(self, library: corpus.Corpus) -> Engine:
        """This engine over another state of its corpus; its stored postings follow."""
        grown = replace(self, library=library, index=None)
        return grown.indexed(self.index_folder, follow=True) if self.index_folder else grown

    def config(self, changes: Mapping[str, Any] | None = None) -> dict[str, Any]:
        """The settings, after changes if there are any."""
        if changes:
            self.settings = override(self.settings, changes)
        return as_dict(self.settings)

    def health(self, live: Mapping[str, Any] | None = None) -> dict[str, Any]:
        """Which sources can answer, and whether the collection fits the live model."""
        out = {"corpus": bool(self.library.lines.head(1)), "vectors": self.points is not None, "reranker": self.scorer is not None, "model": None}
        if live is not None:
            try:
                vectors.assert_model(self.meta, live)
                out["model"] = "ok"
            except (vectors.CorpusNotIngested, vectors.ModelMismatch) as error:
                out["model"] = str(error)
        return out

    def search(self, queries: DataFrame | str, changes: Mapping[str, Any] | None = None, query_vectors: DataFrame | None = None, measured: bool = False) -> hybrid.Result:
        """A text of 1 to 2000 characters, or a DataFrame (query_id, text). Signature lines are taken off first."""
        if isinstance(queries, str):
            if not 1 <= len(queries) <= MOST_QUERY:
                raise RequestError(400, f"a query has 1 to {MOST_QUERY} characters")
            queries = self.spark.createDataFrame([(0, queries)], "query_id bigint, text string")
        if self.library.profile.name == "han":
            parted = queries.withColumn("x", text.split_inscription(F.col("text")))
            queries = parted.withColumn("text", F.when(F.size("x.body") > 0, F.array_join("x.body", "\n")).otherwise(F.col("text"))).drop("x")
        settings = override(self.settings, changes)
        return hybrid.search(queries, self.library.poems, self.library.lines, self.library.profile, settings, self.points, query_vectors, self.scorer, index=self.index, measured=measured)

    def exact_tool(self) -> agent.FunctionTool:
        """A tool for agents: exact search of a text, scored by the longest run."""
        def run(query: str) -> list[dict[str, Any]]:
            asked = self.spark.createDataFrame([(0, query)], "query_id bigint, text string")
            held: list[DataFrame] = []
            outcome, kept = exact.search(asked, self.library.lines, self.library.profile, index=self.index, held=held)
            try:
                longest = outcome.first()
                return [{"id": r["work_id"], "content": r["content"], "score": longest["longest_run"]} for r in exact.ranked_works(kept).orderBy("position").collect()]
            finally:
                for frame in held:
                    frame.unpersist()

        return agent.FunctionTool("search_local_exact", "local", run, seconds=120)

    def semantic_tool(self) -> agent.FunctionTool:
        """A tool for agents: hybrid search; rows below the noise floor come as low_confidence."""
        def run(query: str) -> agent.ToolResult:
            result = self.search(query)
            try:
                shown = self.library.poems.groupBy("work_id").agg(F.min_by("text_display", "poem_id").alias("content"))
                found = result.candidates.join(shown, "work_id").orderBy("position").collect()
            finally:
                result.release()
            rows = tuple({"id": r["work_id"], "content": r["content"], "score": r["rerank_score"]} for r in found)
            best = found[0]["rerank_score"] if found else None
            weak = best is not None and best < self.settings.noise_floor
            return agent.ToolResult("no_result" if not rows else "low_confidence" if weak else "has_result", rows)

        return agent.FunctionTool("search_local_semantic", "vector", run, seconds=120, reason=None if self.scorer else "no reranker is configured")


    def tools(self) -> dict[str, agent.Tool]:
        """The four tools of an agent, in the order in which it should try them."""
        return agent.registry(self.exact_tool(), self.semantic_tool(), agent.web_tool(self.web), agent.ask_model_tool(self.ask))


def run_state(log: DataFrame, run_id: str) -> DataFrame:
    return events.fold_runs(log.where(F.col("run_id") == run_id))


def run_events(log: DataFrame, run_id: str, last_seq: int | None = None) -> DataFrame:
    """Events of a run in order, from where a client stopped."""
    return events.after(log.where(F.col("run_id") == run_id), last_seq).orderBy("seq")


def batch_columns() -> list[dict[str, Any]]:
    return [{"key": k, "group": g, "default": d, "locked": k in batch.LOCKED, "header": batch.header(k)} for k, g, d in batch.EXPORT_COLUMNS]


def batch_rows(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(row_index, raw, values, parse_error) of an uploaded file, or why it is refused."""
    kind = sniff.sniff_file(spark, path)
    if kind.kind == "jsonl":
        return jsonl.read(spark, path, limit)
    if kind.kind == "xlsx":
        rows = xlsx.read(spark, path).withColumn("values", F.try_parse_json("raw")).withColumn("parse_error", F.lit(None).cast("string"))
        return rows if limit is None else rows.where(F.col("row_index") < limit)
    raise RequestError(415, kind.reason + (f" (line {kind.line})" if kind.line else ""))


def batch_scan(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Profiles of the columns of the first 200 rows, and the suggestion."""
    rows = batch_rows(spark, path, SCANNED_ROWS).where("parse_error is null")
    profiles = columns.profile(columns.cells(rows, columns.names_of(rows)))
    return profiles, columns.suggest(profiles)


def batch_estimate(spark: SparkSession, rows: int, with_agent: bool) -> dict[str, Any]:
    one = spark.range(1).select(numbers.estimate(F.lit(rows), F.lit(with_agent)).alias("e")).select("e.*", numbers.human_seconds(F.col("e.seconds")).alias("time"))
    return one.first().asDict(True)


def batch_search(engine: Engine, rows: DataFrame, column: str) -> DataFrame:
    """(row_index, status, confidence, flags, work_ids): a search for each row; faults stay with their row."""
    cell = text.cell_text(F.try_variant_get("values", f"$['{column}']", "variant"))
    queries = rows.select(F.col("row_index").alias("query_id"), "parse_error", cell.alias("text"))
    found = engine.search(queries.where("parse_error is null and text != ''").select("query_id", "text")).outcomes
    met = queries.join(found, "query_id", "left")
    status = batch.row_status(F.col("parse_error"), F.col("text"), F.col("status"))
    return met.select(F.col("query_id").alias("row_index"), status.alias("status"), "confidence", "flags", "work_ids")


def batch_upload(store: jobs.Jobs, path: str, name: str) -> dict[str, Any]:
    """A job for a file: its columns, its rows, and the column that looks like the text to search."""
    rows = batch_rows(store.spark, path)
    headers = columns.names_of(rows.where("parse_error is null").limit(SCANNED_ROWS))
    _, suggestion = batch_scan(store.spark, path)
    found = suggestion.first()
    job_id = store.add(path, name, headers, rows.count())
    return {"job_id": job_id, "headers": headers, "total_rows": store.find(job_id)["total_rows"], "suggested": found["suggested"], "abstain_reason": found["abstain_reason"]}


def batch_start(engine: Engine, store: jobs.Jobs, job_id: str, column: str, rerun: str | None = None) -> dict[str, Any]:
    """Run what is left of a job and say how it ended; the estimate is what it was expected to take."""
    rows = batch_rows(store.spark, store.find(job_id)["path"])
    left = store.begin(job_id, rows, column, rerun)
    pending = left.count()

    def search(some: DataFrame) -> DataFrame:
        found = batch_search(engine, some, column)
        titles = engine.library.works.select("work_id", "title")
        met = found.withColumn("work_id", F.get("work_ids", F.lit(0))).join(titles, "work_id", "left")
        evidence = F.when(F.col("work_id").isNotNull(), F.array(F.struct("work_id", "title"))).otherwise(F.array().cast("array<struct<work_id:string,title:string>>"))
        return met.select("row_index", "status", F.to_json(F.struct("status", "confidence", "flags", evidence.alias("evidence"))).alias("outcome"))

    return {"started": True, "pending_rows": pending, "estimate": batch_estimate(store.spark, pending, False), "status": store.run(job_id, left, search)}


def batch_status(store: jobs.Jobs, job_id: str) -> dict[str, Any]:
    return store.status(job_id)


def batch_list(store: jobs.Jobs, limit: int = 50, offset: int = 0) -> DataFrame:
    return store.listed(limit, offset)


def batch_cancel(store: jobs.Jobs, job_id: str) -> None:
    store.cancel(job_id)


def batch_delete(store: jobs.Jobs, job_id: str) -> None:
    store.delete(job_id)


def batch_export(store: jobs.Jobs, job_id: str, keys: list[str] | None = None, path: str | None = None) -> DataFrame:
    """The rows of a job's file with columns out; with a path, written as the kind of file that came in."""
    source = store.find(job_id)["path"]
    rows = store.export(job_id, batch_rows(store.spark, source), keys)
    made = [c for c in rows.columns if c not in ("row_index", "original")]
    if path and source.endswith(".xlsx"):
        headers = store.find(job_id)["headers"]
        each = ((json.loads(r["original"] or "{}"), r) for r in rows.orderBy("row_index").toLocalIterator())
        xlsx.write(path, [*headers, *made], ([*(o.get(h) for h in headers), *(r[c] for c in made)] for o, r in each))
    elif path:
        jsonl.write(rows.select("row_index", F.col("original").alias("raw"), F.struct(*made).alias("result")), path)
    return rows


@dataclass
class Additions:
    """Poems added to a corpus, in a folder: a log of revisions, of which the last of each addition counts. One writer at a time."""

    engine: Engine
    folder: str
    clock: Callable[[], float] = time.time

    SCHEMA = "addition_id string, title string, author string, text string, content_hash string, status string, origin string, created_at double, revision bigint"

    def _log(self) -> DataFrame:
        spark, version = self.engine.spark, tables.latest_version(self.engine.spark, self.folder)
        paths = [p for p in (f"{self.folder}/v{version}", f"{self.folder}/log-{version}") if tables.exists(spark, p)]
        return spark.read.schema(self.SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], self.SCHEMA)

    def _append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.folder}/log-{tables.latest_version(self.engine.spark, self.folder)}")

    def table(self) -> DataFrame:
        return corpus.last_by(self._log(), "addition_id", F.col("revision"), F.col("status"))

    def compact(self) -> int:
        """Write the last revisions as one table and start a new log; the version number."""
        return tables.replace(self.table(), self.folder)

    def add(self, rows: DataFrame, origin: str = "user") -> DataFrame:
        """rows (row_index, title, author, text) to (row_index, result, missing); what is new is added, as pending where an agent proposed it."""
        if origin not in additions.ORIGINS:
            raise RequestError(400, f"no such origin: {origin}")
        table = self.table()
        held = table.where("status != 'rejected'").select("content_hash")
        if "content_hash" in self.engine.library.poems.columns:
            held = held.union(self.engine.library.poems.select("content_hash"))
        judged = checkpointed(additions.added(rows, held, self.engine.library.profile))
        status = "accepted" if origin == "user" else "pending"
        new = judged.where("result = 'added'").select(F.col("content_hash").alias("addition_id"), "title", "author", "text", "content_hash", F.lit(status).alias("status"), F.lit(origin).alias("origin"), F.lit(float(self.clock())).alias("created_at"))
        last = table.select("addition_id", F.col("revision").alias("last"))
        self._append(new.join(last, "addition_id", "left").withColumn("revision", F.coalesce("last", F.lit(0)) + 1).drop("last"))
        return judged.select("row_index", "result", "missing")

    def searchable(self) -> Engine:
        """The engine over its corpus and all accepted additions; stored postings follow."""
        return self.engine.over(additions.grown(self.engine.library, self.table().where("status = 'accepted'")))

    def listed(self, status: str | None = None, origin: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        try:
            return additions.listed(self.table(), status, origin, limit, offset)
        except ValueError as error:
            raise RequestError(400, str(error)) from error

    def review(self, decisions: DataFrame) -> DataFrame:
        """decisions (addition_id, decision) to (addition_id, review); those on unknown additions are not_found."""
        judged = checkpointed(additions.reviewed(self.table(), decisions))
        names = [f.split()[0] for f in self.SCHEMA.split(", ")]
        self._append(judged.where("review = 'applied'").withColumn("revision", F.col("revision") + 1).select(*names))
        return decisions.select("addition_id").join(judged.select("addition_id", "review"), "addition_id", "left").withColumn("review", F.coalesce("review", F.lit("not_found")))

    def stats(self) -> dict[str, Any]:
        counted = {f"{r['origin']}_{r['status']}": r["n"] for r in additions.counts(self.table()).collect()}
        return {**additions.corpus_counts(self.engine.library.poems).first().asDict(), **counted}


def corpus_rules() -> dict[str, Any]:
    return {"required": ["title", "author", "text"], "optional": ["dynasty", "form", "note", "source_url"], "least_han": additions.LEAST_HAN, "most_han": additions.MOST_HAN, "most_title": additions.MOST_TITLE}


def embed_request(texts: list[str]) -> None:
    """Refuse what an embedder can't take: 1 to 512 texts, none of them blank."""
    if not 1 <= len(texts) <= MOST_TEXTS or any(not t.strip() for t in texts):
        raise RequestError(422, f"1 to {MOST_TEXTS} texts that aren't blank")


def embed(model: service.Embedder, texts: list[str], normalize: bool = True) -> dict[str, Any]:
    embed_request(texts)
    vectors = model.encode(texts)
    if normalize:
        vectors = vectors / (((vectors**2).sum(axis=1, keepdims=True) ** 0.5) + 1e-12)
    return {"vectors": vectors.tolist(), "model_id": model.model_id, "dim": model.dim, "normalized": normalize}


def rerank_request(query: str, documents: list[str]) -> None:
    if not query.strip() or not 1 <= len(documents) <= MOST_DOCUMENTS:
        raise RequestError(422, f"a query and 1 to {MOST_DOCUMENTS} documents")


def rerank(model: service.Reranker, query: str, documents: list[str]) -> dict[str, Any]:
    rerank_request(query, documents)
    return {"scores": [float(x) for x in model.score([(query, d) for d in documents])], "model_id": model.model_id}


def unload(name: str) -> dict[str, bool]:
    return {"unloaded": service.unload(name)}
