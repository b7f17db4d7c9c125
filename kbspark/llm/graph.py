"""Connected components as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, component): smallest id reachable over ``edges`` (a, b), for every id in an edge."""
    up = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = scratch.write(edges.where("a <> b").select(*up).distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        after = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = scratch.write(after.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        seen = tuple(after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        scratch.drop(now)
        now = after
        if seen == mark:
            break
        mark = seen
    roots = now.select("v").distinct().select("v", F.col("v").alias("component"))
    return now.select(F.col("u").alias("v"), F.col("v").alias("component")).unionByName(roots)
