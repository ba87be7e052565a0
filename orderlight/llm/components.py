"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlight.session import stored


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Links between longs -> (node, component): the smallest node that each linked node reaches.

    Every round is a minimum per node, which combines before the shuffle, and a join of the
    links with those minima; no neighbour list is ever gathered. Rounds grow with the logarithm
    of the number of nodes. Each round is written, so a lost executor costs one round at most.
    Null ends and loops are left out; an empty table gives an empty one.
    """
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    edges = links.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    edges = stored(edges, "links")
    before = _mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(floor.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = _mark(edges)
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def forest(size: int, left, right):
    """Root of each of ``size`` local positions under the pairs (left, right), by numpy; used inside a task
    to hand on a spanning forest instead of all pairs."""
    import numpy as np

    root = np.arange(size)
    while len(left):
        a, b = root[left], root[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        keep = root[left] != root[right]
        left, right = left[keep], right[keep]
    return root
