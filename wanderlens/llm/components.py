"""Connected components of a graph given by its edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wanderlens.sources.stored import stored


def _print(edges: DataFrame) -> tuple:
    """Count and sum of hashes of the edges; the same for the same edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges`` (a, b); the label is the smallest node of its component.

    Large stars join each larger neighbour to the least neighbour of a node, small stars each
    smaller one; in between the edges only move, so components stay as they are. When nothing moves,
    each component is a star around its smallest node (Kiveris et al. 2014). The rounds end there,
    after a number of rounds that grows with the logarithm of the graph.
    """
    now = stored(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while (state := _print(now)) != before:
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(
            F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        moved = large.join(small, F.col("a") == F.col("n"))
        now = stored(moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            small.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
    tops = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        tops.select("node", F.col("node").alias("label")))
