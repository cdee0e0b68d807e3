"""The confidence decision table: what the local evidence amounts to, as one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lacuna.config import Thresholds


def _row(status: str, confidence: float, *flags: str, reason: str) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(confidence).alias("confidence"), F.array(*[F.lit(x) for x in flags]).alias("flags"), F.lit(reason).alias("reason"))


def evaluate(kind: Column, works: Column, windows: Column, candidates: Column, top_score: Column, overlap: Column, t: Thresholds = Thresholds()) -> Column:
    """struct(status, confidence, flags, reason); the first rule that holds decides.

    works is the number of works of the exact match; top_score is the best rerank score, null without a reranker."""
    unlike = F.coalesce(overlap < t.overlap, F.lit(False))
    return (
        F.when((kind != "none") & unlike, _row("no_result", 0.0, "no_local_result", reason="exact_below_overlap"))
        .when((kind == "full") & (works == 1), _row("has_result", 1.0, "local_result_found", "exact_full_match", reason="exact_full"))
        .when(kind.isin("full", "ambiguous"), _row("has_result", 0.9, "local_result_found", "exact_ambiguous", reason="exact_ambiguous"))
        .when((kind == "partial") & (windows >= t.windows), _row("has_result", 0.85, "local_result_found", "exact_partial_match", reason="exact_partial"))
        .when(candidates == 0, _row("no_result", 0.0, "no_local_result", reason="no_candidates"))
        .when(top_score.isNull(), _row("low_confidence", 0.3, "local_low_confidence", "local_incomplete", reason="not_reranked"))
        .when(unlike, _row("no_result", 0.0, "no_local_result", reason="below_overlap"))
        .when(top_score < t.noise, _row("no_result", 0.0, "no_local_result", reason="below_noise"))
        .when(top_score >= t.verify, _row("low_confidence", 0.5, "local_low_confidence", reason="likely_candidates"))
        .otherwise(_row("low_confidence", 0.5, "local_low_confidence", reason="candidates"))
    )
