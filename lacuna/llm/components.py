"""Connected components of a table of links, by large-star and small-star rounds.

Each round rewires every node to the least node it knows of; rounds end when nothing changes. Tables are written
between rounds, so lineage stays short and lost executors cost little. Nothing but counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.storage import discard, keep


def components(links: DataFrame) -> DataFrame:
    """(a, b) to (node, root): every node of a link and the least node reachable from it. Nulls and loops are ignored."""
    edges = keep(links.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        last, edges = edges, keep(small.union(lowest.select("a", F.col("m").alias("b"))).distinct(), "links")
        discard(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
    found.__dict__["kept_at"] = edges.__dict__["kept_at"]
    return found
