"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulcost.sources.scratch import cut_lineage, release


def _hooked(edges: DataFrame, lowest: DataFrame) -> DataFrame:
    """Edges (u, v) with ``m``, the lowest of u and its neighbours; hot nodes can be split."""
    return edges.withColumn("_also", F.hash("u")).join(
        lowest.withColumn("_also", F.hash("u")).hint("merge"), ["u", "_also"]
    )


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); the root is the lowest node.

    Alternating large-star and small-star rounds: every node hands its higher
    neighbours to the lowest node it knows, then its lower ones. Both are an
    aggregation and a join, and a number of rounds that grows with the logarithm
    of the graph turns every component into a star around its lowest node.
    """
    edges = cut_lineage(
        links.filter("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m"))
        lowest = lowest.select("u", F.least("u", "m").alias("m"))
        large = cut_lineage(
            _hooked(both, lowest).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        # Every edge now points from a node to a lower one.
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = cut_lineage(
            _hooked(large, lowest)
            .filter("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(lowest.select("u", F.col("m").alias("v")))
            .distinct()
        )
        release(edges, large)
        edges = small
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
