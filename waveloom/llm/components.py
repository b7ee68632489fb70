"""Connected components over an edge table, by alternating stars; nothing is gathered on the driver but a count a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b), component being the least node that can be reached.

    Each round first points the larger neighbours of a node at its least neighbour, then the smaller ones, and stops when
    a round changes nothing. Minima are combined before they are shuffled, so a node with very many edges costs its
    executors no more than its rows; each round is written to the shared folder.
    """
    now = common.staged(
        edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi != lo").distinct(), "edges"
    )
    while True:
        # Larger neighbours: node u's edge (v, u) becomes (v, least neighbour of u). Only a node that has a smaller
        # neighbour itself changes anything.
        least = now.groupBy("hi").agg(F.min("lo").alias("least")).withColumnRenamed("hi", "lo")
        large = now.join(least, "lo", "left").select("hi", F.coalesce("least", "lo").alias("lo"))
        # Smaller neighbours: all of a node's smaller neighbours point at the least of them.
        both = large.union(now.groupBy("hi").agg(F.min("lo").alias("lo"))).filter("hi != lo").distinct()
        both = common.staged(both, "edges")
        least = both.groupBy("hi").agg(F.min("lo").alias("least"))
        small = both.join(least, "hi").select(F.when(F.col("lo") == F.col("least"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("least").alias("lo"))
        then = common.staged(small.filter("hi != lo").distinct(), "edges")
        # Done when every node has one smaller neighbour which has none itself.
        tops = then.select("lo").distinct().withColumnRenamed("lo", "hi")
        open_ends = then.join(tops, "hi", "left_semi").limit(1).count()
        several = 0 if open_ends else then.groupBy("hi").count().filter("count > 1").limit(1).count()
        common.forget(now, both)
        now = then
        if not open_ends and not several:
            break
    members = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return members.union(now.select("lo", "lo").distinct())
