"""Connected components by alternating stars (Kiveris et al. 2014), on plain joins.

An edge points from a larger to a smaller id. Large-star hangs a node's larger neighbours
on its smallest one, small-star does so with its smaller neighbours; the number of rounds
grows with the logarithm of the longest path. A hub is only ever aggregated to a minimum
and joined with one row, so it needs no list of its neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocelens.session import materialise


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges (a, b) with a > b."""
    seen = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = materialise(seen.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_node"), F.least("a", "m").alias("m")))
    joined = seen.join(least, F.col("a") == F.col("_node"))
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("_node").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id that has a link.

    Columns read: a, b. Order, direction and repetition of links do not matter; a link
    from an id to itself gives no row.
    """
    edges = materialise(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    while True:
        edges = materialise(_stars(materialise(_stars(edges, large=True)), large=False))
        # done when every node hangs on one other, which hangs on none
        hung = edges.groupBy("a").agg(F.count("*").alias("n"))
        chained = edges.join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        if hung.where("n > 1").isEmpty() and chained.isEmpty():
            break
    ends = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ends.unionByName(ends.select(F.col("component").alias("id"), "component").distinct())
