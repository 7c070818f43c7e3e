"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .overlap import kept_in

ROUNDS = 30


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge table (a, b) of longs; a component is its smallest node.

    Each step links the neighbours of a node to their minimum.  The minimum is a
    combined aggregate and the link back is a join, so a node with very many neighbours
    is spread over tasks; every step is written to the shared folder, which cuts the
    lineage.
    """
    spark = edges.sparkSession
    now = kept_in(spark, edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(ROUNDS):
        both = now.union(now.select("b", "a"))
        # written first, so that the join has a shuffle of its own and a hub can be split
        low = kept_in(spark, both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "lows")
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = kept_in(spark, large.filter("a <> b").distinct(), "edges")
        least = kept_in(spark, large.groupBy("a").agg(F.min("b").alias("m")), "lows")
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
        now = kept_in(spark, small.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        was, state = state, tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())
        if state == was or not state[0]:
            break
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
