"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a map-side combined minimum for each node and a join back that splits hot nodes; the edges are
written to the shared folder after each round, so lineage stays short and no task or driver gathers links.
The number of rounds grows with the logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, salted_join, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), v < u.  large: all larger neighbours of a node point to its least neighbour; else the smaller ones do."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = written(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "cc-least")
    total = least.agg(F.sum("n")).first()[0] or 0
    joined = salted_join(both, least, ["u"], "n", total, F.col("v"), "inner").withColumn("m", F.least("u", "m"))
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = written(out.where(F.col("u") != F.col("v")).distinct(), "cc-edges")
    removed(edges, least)
    return out


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for all nodes with an edge to another node; component: the smallest node reached."""
    pairs = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(F.col("u") != F.col("v")).distinct()
    pairs, before = written(pairs, "cc-edges"), None
    while True:
        state = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
        pairs = _star(_star(pairs, True), False)
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
