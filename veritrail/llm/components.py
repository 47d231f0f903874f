"""Connected components by alternating large and small stars, on stored edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, stored


def _large_star(edges: DataFrame, small: bool) -> DataFrame:
    """Each node's larger neighbours are tied to the smallest of its neighbourhood; an edge may come out repeatedly, at most one for each that goes in."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.filter("b > a").join(F.broadcast(least) if small else least, "a").select(F.col("m").alias("a"), "b").filter("a < b")


def _small_star(edges: DataFrame, small: bool) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of them; edges have a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    others = edges.join(F.broadcast(least) if small else least, "b").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return others.unionByName(least.select(F.col("m").alias("a"), "b")).filter("a < b").distinct()


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component) of every node with an edge (a, b): the smallest node of its component.

    Every round ends in files, so a lost executor costs one round at most; only a count and
    a checksum of the edges reach the driver.  With ``rounds`` it ends after so many, and a
    component may still be in several parts, each named by one of its nodes.
    """
    edges = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "components")
    state = F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    now = edges.agg(*state).first()
    while True:
        before, small = now, now[0] <= BROADCAST_ROWS
        edges = stored(_small_star(stored(_large_star(edges, small), "components"), small), "components")
        rounds = rounds and rounds - 1
        now = before if rounds == 0 else edges.agg(*state).first()
        if now == before:
            return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")).unionByName(
                edges.select(F.col("a").alias("node")).distinct().join(edges.select(F.col("b").alias("node")), "node", "left_anti").withColumn("component", F.col("node"))
            )
