"""Reciprocal-rank fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fuse(lists: DataFrame, top: int = 50, k: int = 60) -> DataFrame:
    """lists (query_id, list_ord, source, position, work_id) to (query_id, work_id, score, agreement, ranks, fused_position).

    position counts from 0. A work that a list names twice scores twice and its later rank is the one kept. Works of
    equal score and agreement stand in the order in which they first appear."""
    ranked = lists.withColumn("rank", F.col("position") + 1)
    summed = ranked.groupBy("query_id", "work_id").agg(
        F.sum(1 / (F.lit(float(k)) + F.col("rank"))).alias("score"),
        F.count("*").alias("agreement"),
        F.collect_list(F.struct("source", "rank")).alias("pairs"),
        F.min(F.struct("list_ord", "position")).alias("first"),
    )
    last = F.transform(F.array_distinct(F.transform("pairs", lambda p: p["source"])), lambda s: F.struct(s, F.array_max(F.transform(F.filter("pairs", lambda p: p["source"] == s), lambda p: p["rank"]))))
    summed = summed.withColumns({"score": F.round("score", 12), "ranks": F.map_from_entries(F.array_sort(last))})
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("agreement"), "first", "work_id")
    return summed.withColumn("fused_position", F.row_number().over(order) - 1).where(F.col("fused_position") < top).drop("pairs", "first")


def first_of(candidates: DataFrame, values: list[str]) -> DataFrame:
    """One row for each query and work: values of the earliest list, nulls included; metadata maps united."""
    earliest = F.min_by(F.struct(*values), F.struct("list_ord", "position")).alias("v")
    union = F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("list_ord", "position", F.map_entries(F.coalesce("metadata", F.create_map().cast("map<string,string>"))).alias("m")))), lambda x: x["m"]), F.create_map().cast("map<string,string>"), lambda acc, m: F.map_from_entries(F.concat(F.filter(F.map_entries(acc), lambda e: ~F.exists(m, lambda n: n["key"] == e["key"])), m)))
    return candidates.groupBy("query_id", "work_id").agg(earliest, union.alias("metadata")).select("query_id", "work_id", "v.*", "metadata")
