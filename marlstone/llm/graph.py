"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every id in edges (u, v), component the smallest id reachable; ids are longs without nulls.

    Only minima are aggregated and joined, so a hot vertex is combined before its shuffle; minima are checkpointed before they are joined, which leaves plain exchanges on both sides, so AQE can split the partition of a hot vertex. No list of neighbours is ever gathered. Each round is checkpointed in the shared folder; the driver sees one number a round. Self loops and repeated edges are harmless; no edges give no rows.
    """
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(most_rounds):
        # Large star: every larger neighbour of u goes to the least of u and its neighbours.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours go to the least of them.
        large = cut(large)
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    star = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return star.union(edges.select("v", "v").distinct())


def forest(n: int, a, b):
    """numpy: for each of n local vertices the least vertex of its component under links a[i]-b[i]."""
    import numpy as np

    root = np.arange(n)
    while len(a):
        lo, hi = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (lo == hi).all():
            break
        np.minimum.at(root, hi, lo)
        np.minimum.at(root, a, lo)
        np.minimum.at(root, b, lo)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root
