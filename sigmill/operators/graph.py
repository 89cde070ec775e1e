"""Connected components of a graph whose edges are spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpoint, release

#: Edges up to which the steps run in one partition, which needs no shuffle.
FEW_EDGES = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (x, y); root is the component's smallest node.

    Alternating large-star and small-star steps (Kiveris et al. 2014) until nothing changes; each is a few joins of edges, and
    the number of steps grows with the logarithm of the nodes. Null ends and loops are left out.
    """

    def least(df: DataFrame) -> DataFrame:
        return df.groupBy("x").agg(F.min("y").alias("m"))

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()

    edges = checkpoint(edges.filter("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    seen = state(edges)
    gathered = (lambda df: df.coalesce(1)) if seen[0] <= FEW_EDGES else (lambda df: df)
    edges = gathered(edges)
    while seen[0]:
        both = gathered(edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))))
        near = least(both).select("x", F.least("x", "m").alias("m"))
        large = both.join(near, "x").filter("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).filter("x <> y").distinct()
        down = least(large)
        small = large.join(down, "x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        small = gathered(small.unionByName(down.select("x", F.col("m").alias("y")))).filter("x <> y").distinct()
        held, edges = edges, checkpoint(small)
        release(held)
        now = state(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("x").alias("node"), F.col("y").alias("root")).unionByName(edges.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct())
