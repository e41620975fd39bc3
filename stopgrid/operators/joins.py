"""Equi-joins that a few very frequent keys don't slow down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A join key with more rows than total / HEAVY_SHARE is handled by broadcast; at most HEAVY_SHARE keys can be.
HEAVY_SHARE = 10_000


def join_by_count(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join where ``right`` has one row for each key, and ``count`` tells how many rows of ``left`` have it.

    Keys with more than total / HEAVY_SHARE rows, at most HEAVY_SHARE of them,
    are broadcast; each of the others sends at most that many rows to a task.
    """
    most = max(1000, total // HEAVY_SHARE)
    hot = F.broadcast(right.where(F.col(count) > most).withColumn("__hot", F.lit(True)))
    light = right.where(F.col(count) <= most)
    marked = left.join(hot, keys, "left")
    made = [c for c in right.columns if c not in keys]
    return marked.where("__hot").drop("__hot").unionByName(marked.where("__hot is null").drop("__hot", *made).join(light, keys))
