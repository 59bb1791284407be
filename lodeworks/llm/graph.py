"""Connected components of a graph given by its edges, without gathering any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a long, b long): component is its smallest node.

    Alternates large-star and small-star steps until the edges no longer change; then every node hangs on its
    component's smallest. Each step is an aggregate and a join, written to the shared folder, so a lost executor
    costs one step. A hub's edges meet in one partition of a join, which adaptive execution splits where it is large. No edges give no rows; loops are ignored.
    """
    now = shared.written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    was = _digest(now)
    while was[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = shared.written(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a")
        small = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(hung.select("a", F.col("m").alias("b")))
        before, now = now, shared.written(small.where("a <> b").distinct(), "small-star")
        shared.drop(before, large)
        new = _digest(now)
        if new == was:
            break
        was = new
    pairs = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pairs.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
