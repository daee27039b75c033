"""Connected components by large-star and small-star rounds, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parecer.llm.storage import written


def _smallest(pairs: DataFrame) -> DataFrame:
    """For each node the smallest of its neighbours and itself, combined before the shuffle."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (
        both.join(_smallest(both), "u")
        .where((F.col("v") > F.col("u")) & (F.col("v") > F.col("m")))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = (
        edges.join(smallest, "u")
        .where(F.col("v") > F.col("m"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
    )
    return others.union(smallest.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id`` and ``component`` (the smallest node reachable) of every node on an edge
    between two different nodes; loops, repeated edges and edges with nulls change nothing.

    Every round keeps one edge to a smaller node per node and minimum, so the edges never
    grow beyond those given, and stars of any size are split over tasks by the joins. Rounds
    grow with the logarithm of the longest path. Each round is a written table.
    """
    now = written(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "edges",
    )
    while True:
        after = written(_small_star(_large_star(now)), "edges")
        # Done when every node points at one smaller node that itself points nowhere.
        told = after.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        inner = after.join(told.select(F.col("u").alias("v")), "v", "left_semi")
        now = after
        if told.where(F.col("n") > 1).isEmpty() and inner.isEmpty():
            break
    roots = now.select(F.col("v").alias("id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        roots.select("id", F.col("id").alias("component"))
    )
