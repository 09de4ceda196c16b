"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import join_groups, materialise


def components(edges: DataFrame, node: str = "node", root: str = "root") -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for each node of the bigint edges (a, b).

    Alternating large-star and small-star rounds, each with a table written at its end; the number of rounds grows with
    the logarithm of the graph's diameter. Edges are never gathered by node: a star's centre comes from a map-side
    combined minimum, joined back by broadcast for nodes with many edges, so that one node may hold most of them.
    """
    now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        n = now.count()
        large = materialise(_star(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), 2 * n, large=True), "edges")
        after = materialise(_star(large, large.count(), large=False).distinct(), "edges")
        # done when every node hangs on one root that hangs on none
        forks = after.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
        if forks and after.join(after.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").isEmpty():
            break
        now = after
    roots = after.select("v").distinct()
    return after.select(F.col("u").alias(node), F.col("v").alias(root)).unionByName(roots.select(F.col("v").alias(node), F.col("v").alias(root)))


def _star(pairs: DataFrame, n: int, large: bool) -> DataFrame:
    """large: each node's larger neighbours hang on the least of its neighbours and itself; small: its smaller ones and
    itself. ``n`` is the number of pairs; nodes with many of them aren't gathered."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("size")).select("u", F.least("u", "m").alias("m"), "size")
    joined = join_groups(pairs, least, "u", "size", n)
    if large:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
    return joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
