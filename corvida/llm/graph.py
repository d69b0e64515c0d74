"""Connected components of an edge table, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvida.llm.common import delete_table, stored


def _are_stars(edges: DataFrame) -> bool:
    """Whether every left node has one right node, which is nobody's left node."""
    if not edges.groupBy("a").count().where("count > 1").isEmpty():
        return False
    return edges.select("a").join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) but the roots; the root is the component's smallest node.

    Alternating large and small stars, until only stars are left, however many rounds that takes (about the logarithm of the
    diameter). Minima are partially aggregated and stored, as are the edges, so that the joins with them are joins of plain tables,
    in which adaptive execution splits a hub.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m")), "cc-least")
        large = stored(edges.join(least, "b").select("a", F.col("m").alias("b")).where("a <> b").distinct(), "cc-large")
        lower = stored(large.groupBy("a").agg(F.min("b").alias("m")), "cc-lower")
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lower.select("a", F.col("m").alias("b")))
        before, edges = edges, stored(small.where("a <> b").distinct(), "cc")
        for done in (before, least, large, lower):
            delete_table(done)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
