"""Connected components of an edge table: alternating large-star and small-star rounds.

Every round is two joins and two aggregations; its result is written to the shared folder, so lost executors
cost one round at most. Rounds grow with the logarithm of the longest path. Hub nodes are keys of plain
joins, which Spark splits when they are large; no task or driver ever holds a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.session import stage_table


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (a, b) with a > b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if large else edges
    least = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    joined = near.join(least, "a")
    if large:
        linked = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        linked = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return linked.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with a link; root is the smallest node reachable. ``edges``: (a, b), any order."""
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    now = stage_table(now, "links")
    mark = None
    while True:
        facts = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(facts) == mark or not facts[0]:
            break
        mark = tuple(facts)
        now = stage_table(_stars(_stars(now, True), False), "links")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
