"""Connected components by alternating large-star and small-star steps on written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.text import discard, stored


def _settled(edges: DataFrame) -> bool:
    """Whether every node points at one other at most, and none that is pointed at points on: then each component is a star about its least node."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.union(edges.select("b", F.lit(0), F.lit(1)))
    ends = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return ends.filter("out > 1 OR (out = 1 AND into = 1)").isEmpty()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: each node gives its larger neighbours its least neighbour. Small: it gives the same to its smaller ones and itself.

    The least neighbours are a written table, so that the adaptive join can broadcast a small one and split the edges of a
    hub otherwise, which it does not where a side is an aggregate.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.filter("b < a")
    # in two steps, so that a hub is no row for every task before in one task
    part = both.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(32))).groupBy("a", "part").agg(F.min("b").alias("m"))
    least = stored(part.groupBy("a").agg(F.min("m").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    out = both.join(least, "a")
    if large:
        out = out.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    found = stored(out.filter("a <> b").distinct(), "edges")
    discard(least)
    return found


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) to (node, component), the least node reachable, for every node with a link. Ends when all components are stars."""
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _settled(edges):
        for large in (True, False):
            old, edges = edges, _star(edges, large)
            discard(old)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
