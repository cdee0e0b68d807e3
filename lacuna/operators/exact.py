"""Exact n-gram search of queries over corpus lines, set by set.

Windows of each reading meet the lines through an equi-join on a gram at one of their first places; the rest of the window
is compared in place. No pair of window and line is looked at that doesn't share a gram. Windows are broadcast where
there are at most BROADCAST_WINDOWS of them, else both sides are shuffled by gram; of the lines only those whose grams have
the hash of one that is wanted, where there are at most corpus.BROADCAST_GRAMS.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.config import Profile
from lacuna.functions import text
from lacuna.operators import corpus, seeds
from lacuna.operators.readings import enumerate_readings, span_to_source

BROADCAST_WINDOWS = 500_000
KEY = ["query_id", "ord"]


def sweep(readings: DataFrame, profile: Profile) -> DataFrame:
    """(query_id, ord, at, win): the windows of each reading; at is where a window first stands."""
    each = readings.select(*KEY, "chars", F.explode(text.windows(F.col("chars"), profile)).alias("win"))
    return each.select(*KEY, (F.instr("chars", F.col("win")) - 1).alias("at"), "win")


def hits(windows: DataFrame, lines: DataFrame | None, profile: Profile, sized: bool = True, index: corpus.Index | None = None) -> DataFrame:
    """Lines that contain a window, hits_per_window at most for each, by poem and line. A stored index is read only in the buckets of its grams."""
    # one comparison settles most postings, and the lengths are looked through only where the shortest window matches
    met = touched(windows, lines, profile, sized, index).where(F.substring(F.col("text_match"), F.col("start"), F.col("least")) == F.substring(F.col("longest"), F.lit(1), F.col("least")))
    matching = F.filter("sizes", lambda n: F.substring(F.col("text_match"), F.col("start"), n) == F.substring(F.col("longest"), F.lit(1), n))
    of_window = Window.partitionBy(*KEY, "win").orderBy("poem_id", "line_no")
    if index and index.seeds is not None:
        each = met.select(*KEY, "at", "longest", "poem_id", "work_id", "line_no", F.explode(matching).alias("n")).withColumn("win", F.substring("longest", F.lit(1), F.col("n"))).drop("longest", "n")
        kept = each.withColumn("k", F.dense_rank().over(of_window)).where(F.col("k") <= profile.hits_per_window).drop("k").dropDuplicates([*KEY, "win", "poem_id", "line_no"])  # a line counts once
        return shown(kept, index)
    each = met.select(*KEY, "at", "longest", "start", "text_match", "poem_id", "work_id", "line_no", "text_display", F.explode(matching).alias("n"))
    found = each.withColumn("win", F.substring("longest", F.lit(1), F.col("n")))
    found = found.where(F.instr("text_match", F.col("win")) == F.col("start")).drop("longest", "n", "start", "text_match")  # a line counts once
    return found.withColumn("k", F.row_number().over(of_window)).where(F.col("k") <= profile.hits_per_window).drop("k")


def shown(found: DataFrame, index: corpus.Index) -> DataFrame:
    """Hits with the text of their lines, which is stored once."""
    return found.join(corpus.numbered(found, index.lines.select("poem_id", "line_no", "text_display")), ["poem_id", "line_no"])


def touched(windows: DataFrame, lines: DataFrame | None, profile: Profile, sized: bool = True, index: corpus.Index | None = None) -> DataFrame:
    """Postings that windows meet, before the rest of a window is compared; `start` is where it would begin in text_match.

    Windows that begin at one place are joined once, and the lengths that match are read off. Lines are indexed at every
    `stride`-th place only: a window is looked up by its grams at as many offsets, of which one meets an indexed place.
    Stored grams name the lines that are looked at; an index by seeds is asked for the rarest of these grams alone."""
    size, step = F.length("win").alias("n"), corpus.stride(profile)
    places = windows.groupBy(*KEY, "at").agg(F.max(F.struct(size, "win"))["win"].alias("longest"), F.min(F.length("win")).alias("least"), F.collect_set(size).alias("sizes"))
    by = "seed" if index and index.seeds is not None else "gram"
    if by == "seed":
        places = seeds.lookups(places, profile, index.frequency)
    else:
        places = places.withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(step - 1)))).withColumn("gram", F.substring("longest", F.col("offset") + 1, F.lit(profile.seed)))
    n = places.count() if sized else None
    small = n is not None and n <= BROADCAST_WINDOWS
    if by == "seed":
        wanted = places.select(by).distinct()
        held = index.lines
        if wanted.count() <= corpus.BROADCAST_GRAMS:
            held = corpus.numbered(seeds.named(index.marks, wanted.toArrow()[by].to_numpy()), held)
        stored = seeds.postings(held.select("poem_id", "work_id", "line_no", "text_match"), profile, index.frequency)
    else:
        stored = corpus.postings(corpus.lines_with(places, index) if index else lines, profile.seed, step)
        if n is not None and not small and n <= corpus.BROADCAST_GRAMS:  # hashes are small enough: lines of other grams aren't shuffled
            stored = corpus.of_grams(stored.withColumn("__gram", corpus.gram_hash("gram")), "__gram", places)
    places = F.broadcast(places) if small else places
    met = stored.join(places, by).withColumn("start", F.col("place") - F.col("offset")).where("start >= 1")
    return met.withColumn("start", F.col("start") - F.col("first") + 1).withColumnRenamed("around", "text_match") if by == "seed" else met


def inversions(order: np.ndarray) -> int:
    """Pairs of a sequence of distinct numbers that come in falling order, bit by bit of their ranks.

    Two ranks differ first in some bit: they are inverted where the one before has it and the one behind hasn't, among those
    that agree in all higher bits."""
    rank, total = np.argsort(np.argsort(order, kind="stable"), kind="stable"), 0
    for bit in range(max(1, len(rank)).bit_length() - 1, -1, -1):
        by = np.argsort(rank >> (bit + 1), kind="stable")
        group, one = (rank >> (bit + 1))[by], (rank[by] >> bit) & 1
        before = np.cumsum(one) - one
        total += int(((before - before[np.searchsorted(group, group)]) * (1 - one)).sum())
    return total


def _inverted(pairs: pd.Series) -> pd.Series:
    def judged(rows: Sequence[dict]) -> bool:
        at, line = (np.array([r[k] for r in rows], dtype=np.int64) for k in ("at", "line_no"))
        by = np.lexsort((at, line))
        first = by[np.unique(line[by], return_index=True)[1]]  # where each line first matches
        seq = line[first][np.lexsort((line[first], at[first]))]
        n = len(seq)
        return n >= 3 and inversions(seq) / (n * (n - 1) / 2) > 0.33

    return pairs.map(judged)


def inverted(pairs: Column) -> Column:
    """Whether lines come in another order than the input: pairs of (at, line_no), one for each hit.

    Lines are put in order of where they first match; of all pairs of three lines or more, over a third has to be inverted."""
    return F.pandas_udf(_inverted, "boolean")(pairs)


def evidence(found: DataFrame) -> DataFrame:
    """By query, reading and work: longest window, distinct windows, order of lines."""
    pairs = F.collect_set(F.struct("at", "line_no"))
    longest = F.max(F.struct(F.length("win").alias("n"), (-F.col("at")).alias("back"), F.col("win").alias("win")))
    return found.groupBy(*KEY, "work_id").agg(longest.alias("best"), F.count_distinct("win").alias("windows_matched"), F.count_distinct("text_display").alias("lines_matched"), pairs.alias("pairs")).select(
        *KEY, "work_id", F.col("best.n").alias("longest_run"), F.col("best.win").alias("best_window"), (-F.col("best.back")).alias("best_at"), "windows_matched", "lines_matched", inverted(F.col("pairs")).alias("out_of_order")
    )


def scores(per_work: DataFrame) -> DataFrame:
    """By query and reading: the works that tie for the longest and most windows."""
    ranked = per_work.withColumn("rank", F.rank().over(Window.partitionBy(*KEY).orderBy(F.desc("longest_run"), F.desc("windows_matched"))))
    top = ranked.where("rank = 1")
    return top.groupBy(*KEY).agg(
        F.sort_array(F.collect_list("work_id")).alias("work_ids"),
        F.max("longest_run").alias("longest_run"),
        F.max("windows_matched").alias("windows_matched"),
        F.min_by("out_of_order", "work_id").alias("out_of_order"),
        F.min_by(F.struct("best_at", F.length("best_window").alias("n")), "work_id").alias("span"),
    )


def classify(works: Column, longest: Column, windows: Column, profile: Profile) -> Column:
    """full, ambiguous, partial or none."""
    return (
        F.when(F.coalesce(F.size(works), F.lit(0)) <= 0, "none")
        .when(longest >= profile.decisive, F.when(F.size(works) == 1, "full").otherwise("ambiguous"))
        .when(windows >= 2, "partial")
        .otherwise("none")
    )


def search(queries: DataFrame, lines: DataFrame, profile: Profile, readings: DataFrame | None = None, index: corpus.Index | None = None, held: list[DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Outcome of each query that has a reading, and the hits of its chosen reading.

    Readings other than the one as written are only swept for queries that it doesn't decide. Hits, which caps bound, are
    cached: scores, decisions and the result share them. What is cached is added to `held`, to be released by whoever reads the result."""
    held = [] if held is None else held

    def cached(frame: DataFrame) -> DataFrame:
        held.append(frame.cache())
        return held[-1]

    every = cached((readings if readings is not None else enumerate_readings(queries, profile)).where(F.col("ord") < profile.max_readings))
    plain, others = every.where("not reordered"), every.where("reordered")
    first = cached(hits(sweep(plain, profile), lines, profile, index=index))
    first_scores = cached(scores(evidence(first)))
    decided = first_scores.where((F.col("longest_run") >= profile.decisive) & (F.size("work_ids") == 1)).select("query_id")
    second = cached(hits(sweep(others.join(decided, "query_id", "left_anti"), profile), lines, profile, index=index))
    found, scored = first.unionByName(second), first_scores.unionByName(scores(evidence(second)))
    choice = Window.partitionBy("query_id").orderBy(F.desc("longest_run"), F.asc("ord"))
    chosen = scored.withColumn("n", F.row_number().over(choice)).where("n = 1").drop("n")
    out = every.select("query_id").distinct().join(chosen, "query_id", "left").join(every.select(*KEY, "strategy", "cols", "reordered", "chars", "source_index"), KEY, "left")
    kind = classify(F.col("work_ids"), F.col("longest_run"), F.col("windows_matched"), profile)
    out = out.withColumn("kind", kind)
    flags = F.array_compact(F.array(
        F.when(F.col("kind") == "full", "exact_full_match").when(F.col("kind") == "partial", "exact_partial_match").when(F.col("kind") == "ambiguous", "exact_ambiguous"),
        F.when((F.col("kind") != "none") & (F.col("reordered") | F.col("out_of_order")), "input_reordered"),
    ))
    source = span_to_source(F.col("source_index"), F.col("span.best_at"), F.col("span.best_at") + F.col("span.n"))
    works = F.when(F.col("kind") != "none", F.col("work_ids")).otherwise(F.array().cast("array<string>"))
    outcome = out.select("query_id", "kind", works.alias("work_ids"), F.coalesce("windows_matched", F.lit(0)).alias("windows_matched"), F.coalesce("longest_run", F.lit(0)).alias("longest_run"), "strategy", "cols", F.col("chars").alias("reading"), flags.alias("flags"), source.alias("matched_span"))
    kept = found.join(chosen.select(*KEY, F.explode("work_ids").alias("work_id")), [*KEY, "work_id"])
    return outcome, kept


def ranked_works(kept: DataFrame) -> DataFrame:
    """(query_id, work_id, poem_id, content, n_lines, position): works of the hits by number of distinct lines."""
    by = kept.groupBy("query_id", "work_id").agg(F.count_distinct("text_display").alias("n_lines"), F.min("poem_id").alias("poem_id"), F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("line_no", "text_display"))), lambda x: x["text_display"]), "\n").alias("content"))
    return by.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n_lines"), "work_id")) - 1)
