"""Connected components of an edge table, without gathering it anywhere.

Alternating star operations: each node's neighbours are hung on the smallest
node around, first the larger neighbours, then the smaller ones, until the
edges are stars around the smallest node of each component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.spread import spread_join
from scanloom.llm.storage import Stash


def connected_components(edges: DataFrame, stash: Stash) -> DataFrame:
    """(node, component): the smallest node reachable, for the nodes that have one smaller than themselves.

    edges: (u, v), in either direction, repeated or not; loops and nulls are
    left out.  A node of very many edges is dealt over many tasks.
    """
    tidy = edges.filter("u <> v").select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("m")).distinct()
    current, step = stash.keep(tidy, "stars-0"), 0
    while not _are_stars(current):
        both = current.select("v", "m").union(current.select(F.col("m").alias("v"), F.col("v").alias("m")))
        low = both.groupBy("v").agg(F.min("m").alias("low")).select("v", F.least("low", "v").alias("low"))
        large = spread_join(both, low, ["v"]).filter("m > v").select(F.col("m").alias("v"), F.col("low").alias("m")).distinct()
        large = stash.keep(large, f"large-{step}")
        least = large.groupBy("v").agg(F.min("m").alias("low"))
        small = spread_join(large, least, ["v"]).filter("m > low").select(F.col("m").alias("v"), F.col("low").alias("m")).union(least.select("v", F.col("low").alias("m"))).distinct()
        step += 1
        current = stash.keep(small, f"stars-{step}")
        stash.drop(f"stars-{step - 1}")
        stash.drop(f"large-{step - 1}")
    return current.select(F.col("v").alias("node"), F.col("m").alias("component"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one other, which hangs on none."""
    per_node = edges.groupBy("v").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    if per_node > 1:
        return False
    return edges.select("m").join(edges.select(F.col("v").alias("m")), "m", "left_semi").isEmpty()
