"""Mixing sources to target weights along a curriculum whose weights change over time.

Each source has a schedule: weights at knots over training time 0 to 1, linear between them. The integral of a
schedule is the source's weight; targets share `share` times all words by weight, none above `most` times its source,
and the excess goes to the others by weight (water filling: the level is found from sums over sources in the order
in which they fill up). Within a source, documents stand in the order of the md5 of their id; a target of 1.4 times
the source takes every document once and the first 0.4 of the words again, the last of them in part, so that a
source's words meet its target. Words k of a source come due where the integral of its schedule has reached
k / target: that position, found by inverting the piecewise quadratic integral, orders the mix.

Running sums never put a source in one task: documents are dealt to 4096 buckets of the md5, those without id to buckets
of their size, 64 for each; the sums of buckets are added up, and each bucket adds its own documents. Rows of one id that
isn't null share a bucket.

Cases: a null text has 0 words and takes nothing; the null source is a source, the last; repeated rows are documents
of their own; null ids come first; an empty table gives an empty plan; a source without words has target 0. Columns
of documents pass through, those named like a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.storage import keep

NULL_BUCKETS = 64
WORD = r"[^\x20\x09-\x0D]+"
Schedule = tuple[tuple[float, float], ...]
RESULT = ("size", "source_size", "target", "taken", "placements")


@dataclass(frozen=True)
class Settings:
    """schedules are dealt to the sources in order of name, again and again; their integrals are 3, 1 and 2."""

    schedules: tuple[Schedule, ...] = (((0.0, 4.0), (1.0, 2.0)), ((0.0, 0.5), (0.5, 0.5), (1.0, 2.5)), ((0.0, 2.0), (1.0, 2.0)))
    share: float = 1.5
    most: int = 2


def integral(schedule: Schedule) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))


def due(schedule: Schedule, part: Column) -> Column:
    """The time at which the integral of a schedule has reached this part of the whole."""
    whole, reached, segments = integral(schedule), 0.0, []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        slope = (w1 - w0) / (t1 - t0)
        rest = part * F.lit(whole) - F.lit(reached)
        # slope / 2 x^2 + w0 x = rest, in the form that also holds for slope 0
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0)))
        reached += (t1 - t0) * (w0 + w1) / 2
        segments.append((reached, F.lit(t0) + 2 * rest / F.greatest(F.lit(w0) + root, F.lit(1e-12))))
    at = segments[-1][1]
    for upto, earlier in reversed(segments[:-1]):
        at = F.when(part * F.lit(whole) <= upto, earlier).otherwise(at)
    return F.least(at, F.lit(1.0))


def targets(sizes: DataFrame, s: Settings) -> DataFrame:
    """(source, source_size, rank, target): a row for each source; the windows run over sources alone."""
    weights = F.array(*[F.lit(integral(x)) for x in s.schedules])
    named = Window.orderBy(F.col("source").asc_nulls_last())
    filling = Window.orderBy("fills", F.col("source").asc_nulls_last())
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.withColumn("rank", F.row_number().over(named) - 1).withColumn("weight", weights[F.col("rank") % len(s.schedules)])
    sources = sources.withColumn("full", s.most * F.col("source_size")).withColumn("fills", F.col("full") / F.col("weight"))
    before = F.coalesce(F.sum("full").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    level = (s.share * F.sum("source_size").over(everything) - before) / onward
    sources = sources.withColumn("level", level)
    reached = F.min(F.when(F.col("level") <= F.col("fills"), F.struct("fills", F.col("level")))).over(everything)["level"]
    return sources.select("source", "source_size", "rank", F.least(F.col("full").cast("double"), F.coalesce(reached, F.lit(float("inf"))) * F.col("weight")).alias("target"))


def mix(documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    """documents, without their text, with size, source_size, target, taken and placements (copy, words, position)."""
    kept = [c for c in documents.columns if c.lower() not in (*RESULT, "text", "source", "doc_id")]
    others = [F.struct(*kept).alias("others")] if kept else []  # their names can't clash with those used here
    sizes = keep(documents.select("doc_id", "source", *others, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size")), "mixing-sizes")
    goal = targets(sizes.select("source", "size"), s).select(F.col("source").alias("of_source"), "source_size", "rank", "target")
    key = F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit(""))
    # rows without id of one size are alike, so they may be dealt in any way; "!" sorts before all digits
    apart = F.format_string("!%015d-%02d", "size", F.pmod(F.monotonically_increasing_id(), F.lit(NULL_BUCKETS)))
    dealt = sizes.withColumn("key", key).withColumn("bucket", F.when(F.col("doc_id").isNull(), apart).otherwise(F.substring("key", 1, 3)))
    by_bucket = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_bucket.select(F.col("source").alias("of_source"), F.col("bucket").alias("of_bucket"), F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("bucket_start"))
    starts = starts.alias("b").join(goal.alias("g"), F.col("b.of_source").eqNullSafe(F.col("g.of_source"))).select("b.of_source", "of_bucket", "bucket_start", "source_size", "rank", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("bucket") == F.col("of_bucket")))
    start = F.col("bucket_start") + F.col("within")
    goal_words = F.round("target").cast("bigint")

    def placement(copy: int) -> Column:
        from_ = start + copy * F.col("source_size")
        words = F.greatest(F.least(goal_words - from_, F.col("size")), F.lit(0))
        part = from_ / F.greatest(F.col("target"), F.lit(1.0))
        position = F.coalesce(*[F.when(F.col("rank") % len(s.schedules) == i, due(x, part)) for i, x in enumerate(s.schedules)])
        return F.struct(F.lit(copy).alias("copy"), words.alias("words"), position.alias("position"))

    placements = F.filter(F.array(*[placement(c) for c in range(s.most)]), lambda p: p["words"] > 0)
    out = rows.withColumn("placements", placements)
    taken = F.aggregate("placements", F.lit(0).cast("bigint"), lambda total, p: total + p["words"])
    return out.select("doc_id", "source", *[f"others.{c}" for c in kept], "size", "source_size", "target", taken.alias("taken"), "placements")


def _ranged(rows: DataFrame, by: list[Column], partitions: int | None) -> DataFrame:
    return (rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)).sortWithinPartitions(*by)


def ordered(mixed: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row for each placement, range-sorted by position: the order of training."""
    rows = mixed.withColumn("placement", F.explode("placements")).drop("placements").select("*", "placement.*").drop("placement")
    return _ranged(rows, [F.col("position"), F.col("doc_id"), F.col("copy")], partitions)


def by_first_position(mixed: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row for each document, with the position of its first placement (null, and last, if it has none), range-sorted by it."""
    rows = mixed.withColumn("position", F.get("placements", F.lit(0))["position"])
    return _ranged(rows, [F.col("position").asc_nulls_last(), F.col("doc_id")], partitions)
