"""Joins whose hot keys don't meet in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 10_000


def hot_join(left: DataFrame, right: DataFrame, key: str, weight: Column, total: int) -> DataFrame:
    """Join by a key of which right has one row each; weight says how many of the `total` rows of left hold it.

    Keys that hold more than a 10,000th of all rows can be 10,000 at most: they are broadcast, and rows of left stay where
    they are. The others are shuffled, none of them a large share of its partition."""
    hot = weight > max(1.0, total / HOT_KEYS)
    head = right.where(hot)
    rest = left.join(F.broadcast(head.select(key)), key, "left_anti").join(right.where(~hot), key)
    return left.join(F.broadcast(head), key).unionByName(rest)
