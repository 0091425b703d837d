"""Connected components as DataFrame steps (distributed union-find)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """``edges(a bigint, b bigint)`` -> ``(node, root)``, root the smallest node
    of the component; nodes without an edge do not appear.

    Alternates large-star and small-star: every round hangs each node's
    neighbours on the smallest one, by a min() aggregate (combined map-side)
    and a join that adaptive execution can split at a hub, so no neighbour list
    is ever collected. Each round is a written table; the driver sees one
    count. It ends when every edge leads to a root that is no one's child.
    """
    e = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(),
                     f"{name}-0")
    i = 0
    while True:
        both = e.select(F.col("v").alias("x"), F.col("u").alias("y")).union(e.select(F.col("u").alias("x"), F.col("v").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("v"), F.col("m").alias("u"))
        large = large.where("v <> u").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
                 .union(least.select("v", F.col("m").alias("u"))).where("v <> u").distinct())
        i += 1
        nxt = scratch.keep(small, f"{name}-{i}")
        done = not nxt.select(F.col("u").alias("v")).join(nxt.select("v"), "v", "left_semi").head(1)
        scratch.drop(f"{name}-{i - 1}")
        e = nxt
        if done:  # every parent is a root, so each node has one edge, to the least node
            if not e.groupBy("v").agg(F.countDistinct("u").alias("n")).where("n > 1").head(1):
                break
    return e.select(F.col("v").alias("node"), F.col("u").alias("root")).union(
        e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
