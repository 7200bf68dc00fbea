"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang a node's neighbours (the larger, or the others) on the smallest node among itself and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if large:
        smallest = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        hung = both.join(smallest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = both.where("v < u")
        smallest = down.groupBy("u").agg(F.min("v").alias("m"))
        hung = down.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            smallest.select("u", F.col("m").alias("v"))
        )
    return hung.where("u != v").distinct()


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node that has a link; the component is its smallest node.

    Each round shortens all paths at once, so rounds grow with the logarithm of the longest path. Rounds
    are written to the shared folder, which cuts the lineage; only two sums reach the driver. A node with
    very many neighbours is one row after the aggregation and is joined by a join that splits skew.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    edges = stored(edges, "links")
    before = None
    while True:
        edges = stored(_star(_star(edges, large=True), large=False), "links")
        state = edges.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s"),
        ).first()
        if state == before:
            break
        before = state
    # Now every edge leads to the smallest node of its component.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
