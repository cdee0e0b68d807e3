"""Hybrid search: exact, then BM25 and vectors for what it leaves open, fusion, rerank and the decision."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.config import Profile, Settings, Thresholds
from lacuna.functions import text
from lacuna.operators import bm25, confidence, corpus, exact, fusion, service, vectors
from lacuna.storage import checkpointed

#: A scorer takes (query_id, work_id, query, content) and returns it with rerank_score.
Scorer = Callable[[DataFrame], DataFrame]
BROADCAST_WORKS = 500_000
SOURCES = ("exact", "bm25", "vector", "reranker")


@dataclass(frozen=True)
class Result:
    """outcomes: a row for each query; candidates: its fused works; reports: a row for each query and source.

    Parts that they share are cached until release()."""

    outcomes: DataFrame
    candidates: DataFrame
    reports: DataFrame
    held: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        for frame in self.held:
            frame.unpersist()


def lexical_scorer(pairs: DataFrame) -> DataFrame:
    """A deterministic scorer that needs no model: overlap of distinct characters."""
    return pairs.withColumn("rerank_score", text.lexical_overlap(F.col("query"), F.col("content")))


def short_circuited(outcome: DataFrame) -> Column:
    """Whether a query needs no other source: a full match of one work."""
    return (outcome["kind"] == "full") & (F.size(outcome["work_ids"]) == 1)


def report(queries: DataFrame, source: str, counts: DataFrame | None, skipped: DataFrame, available: bool = True, went: Mapping[str, Any] | None = None) -> DataFrame:
    """(query_id, source, status, n, latency_ms, error_code, error_message): skipped after a short circuit, unavailable without a
    model, timeout or error where the source failed, else found or not. went: how the source went as a whole, where that was measured."""
    went = went or {}
    frame = queries.select("query_id").join(skipped.select("query_id", F.lit(True).alias("s")), "query_id", "left")
    if counts is None:
        n = F.lit(0).cast("bigint")
    else:
        frame, n = frame.join(counts, "query_id", "left"), F.coalesce(F.col("n"), F.lit(0)).cast("bigint")
    status = F.when(F.coalesce("s", F.lit(False)), "skipped").when(F.lit(not available), "unavailable").when(F.lit(went.get("status")).isNotNull(), F.lit(went.get("status"))).when(n > 0, "has_result").otherwise("no_result")
    return frame.select("query_id", F.lit(source).alias("source"), status.alias("status"), F.when(status.isin("has_result", "no_result"), n).otherwise(F.lit(0)).alias("n"),
        *[F.when(~status.isin("skipped", "unavailable"), F.lit(went.get(c)).cast(kind)).alias(c) for c, kind in (("latency_ms", "double"), ("error_code", "string"), ("error_message", "string"))])


def described(source: Column, status: Column, n: Column, short: Column) -> Column:
    """A source report in words."""
    name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in ("exact", "Exact search", "bm25", "Term search", "vector", "Vector search", "reranker", "Reranker")]), source), source)
    return (
        F.when(status == "skipped", F.when(short, F.concat(name, F.lit(": not needed, an exact match decided"))).otherwise(F.concat(name, F.lit(": skipped"))))
        .when(status.isin("unavailable", "timeout", "error"), F.concat(name, F.lit(": "), status))
        .when(n == 0, F.concat(name, F.lit(": nothing found")))
        .otherwise(F.concat(name, F.lit(": "), n.cast("string"), F.lit(" found")))
    )


def _listed(ranked: DataFrame, order: int, source: str, **metadata: str) -> DataFrame:
    """A source's ranked works as a list for fusion, with what it knows of them."""
    known = F.create_map(*[x for k, c in metadata.items() for x in (F.lit(k), F.col(c).cast("string"))])
    return ranked.select("query_id", F.lit(order).alias("list_ord"), F.lit(source).alias("source"), "position", "work_id", "poem_id", known.alias("metadata"))


def search(queries: DataFrame, poems: DataFrame, lines: DataFrame, profile: Profile, settings: Settings = Settings(), points: DataFrame | vectors.Coded | None = None, query_vectors: DataFrame | None = None, scorer: Scorer | None = None, readings: DataFrame | None = None, index: corpus.Index | None = None, measured: bool = False) -> Result:
    """queries (query_id, text); points (point_id, vector, work_id), as they are or coded, and query_vectors (query_id, vector) are optional.

    index: stored postings of the same corpus. measured: run BM25 and vectors one by one and checkpointed; reports then
    have their latency, and one that fails is reported with its error while the others go on."""
    held: list[DataFrame] = []
    outcome, kept = exact.search(queries, lines, profile, readings, index, held)
    outcome, kept = outcome.cache(), kept.cache()
    held += [outcome, kept]
    decided = outcome.where(short_circuited(outcome)).select("query_id")
    open_ = queries.join(decided, "query_id", "left_anti")
    ranked = exact.ranked_works(kept)
    lists = [_listed(ranked, 0, "exact", n_lines="n_lines")]
    went: dict[str, dict[str, Any]] = {}

    def source(name: str, run: Callable[[], DataFrame]) -> DataFrame | None:
        if not measured:  # fusion and reports read these lists: fuse_top rows of a query, at the price of a pass over everything
            held.append(run().cache())
            return held[-1]
        found, went[name] = service.timed(lambda: checkpointed(run()))
        return found

    terms = source("bm25", lambda: bm25.search(open_, poems, profile, settings.fuse_top, index=index))
    if terms is not None:
        lists.append(_listed(terms, 1, "bm25", matched_terms="matched_terms", bm25_score="score"))
    near, has_vectors = None, points is not None and query_vectors is not None
    if has_vectors:
        coded = isinstance(points, vectors.Coded)
        rows = points.points if coded else points

        def nearest() -> DataFrame:
            asked = query_vectors.join(open_.select("query_id"), "query_id", "left_semi")
            found = points.search(asked, settings.fuse_top)[0] if coded else vectors.search(asked, points, settings.fuse_top)
            return found.join(rows.select("point_id", "work_id"), "point_id")

        near = source("vector", nearest)
        if near is not None:
            lists.append(_listed(near.withColumn("poem_id", F.lit(None).cast(poems.schema["poem_id"].dataType)), 2, "vector", vector_score="score"))
    every = reduce(DataFrame.unionByName, lists)
    fused = fusion.fuse(every, settings.fuse_top, settings.rrf_k).cache()
    held.append(fused)
    named = fused.select("work_id").distinct()
    named = F.broadcast(named) if named.count() <= BROADCAST_WORKS else named
    contents = poems.join(named, "work_id", "left_semi").groupBy("work_id").agg(F.min_by("text_match", "poem_id").alias("content"))
    forms = queries.select("query_id", F.coalesce(F.nullif(text.match_form(F.col("text"), profile), F.lit("")), F.col("text")).alias("query"))
    pairs = fused.join(contents, "work_id").join(forms, "query_id")
    scored = scorer(pairs) if scorer else pairs.withColumn("rerank_score", F.lit(None).cast("double"))
    best = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "fused_position")
    top = scored.withColumn("position", F.row_number().over(best) - 1).where(F.col("position") < settings.top_k)
    first = top.where("position = 0").select("query_id", F.col("rerank_score").alias("top_score"), text.lexical_overlap(F.col("query"), F.col("content")).alias("overlap"))
    counts = fused.groupBy("query_id").agg(F.count("*").alias("candidates"))
    judged = queries.select("query_id").join(outcome, "query_id", "left").join(first, "query_id", "left").join(counts, "query_id", "left")
    thresholds = Thresholds(settings.verify_floor, settings.noise_floor, 2, settings.overlap_floor)
    kind, found = F.coalesce("kind", F.lit("none")), F.coalesce("candidates", F.lit(0))
    verdict = confidence.evaluate(kind, F.coalesce(F.size("work_ids"), F.lit(0)), F.coalesce("windows_matched", F.lit(0)), found, F.col("top_score"), F.col("overlap"), thresholds)
    judged = judged.select("query_id", kind.alias("kind"), "work_ids", "strategy", F.col("flags").alias("exact_flags"), found.alias("candidates"), "top_score", "overlap", verdict.alias("v"))
    judged = judged.select("*", "v.*").drop("v").withColumn("flags", F.array_distinct(F.concat(F.coalesce("exact_flags", F.array().cast("array<string>")), "flags")))

    def count(frame: DataFrame) -> DataFrame:
        return frame.groupBy("query_id").agg(F.count("*").alias("n"))

    nobody = queries.select("query_id").where(F.lit(False))
    reports = report(queries, "exact", count(ranked), nobody)
    reports = reports.unionByName(report(queries, "bm25", count(terms) if terms is not None else None, decided, went=went.get("bm25")))
    reports = reports.unionByName(report(queries, "vector", count(near) if near is not None else None, decided, has_vectors, went.get("vector")))
    reports = reports.unionByName(report(queries, "reranker", count(top), queries.select("query_id").join(counts, "query_id", "left_anti"), scorer is not None))
    about = fusion.first_of(every.join(top.select("query_id", "work_id"), ["query_id", "work_id"], "left_semi"), ["poem_id"])
    return Result(judged, top.drop("query", "content").join(about, ["query_id", "work_id"], "left"), reports, tuple(held))
