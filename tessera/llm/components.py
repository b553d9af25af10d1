"""Connected components by alternating large and small stars, each round cut by a reliable checkpoint.

A node with very many neighbours is one row of each, which aggregation adds up in part before the shuffle and
adaptive execution splits in the join. Defined cases: repeated edges, edges both ways and edges of a node to
itself count once or not at all; nodes without an edge have no row; edges with a null end are left out; no edges
give no rows; more rounds than the limit raise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: larger neighbours of each node move to its least neighbour. Small star: the node and its smaller neighbours do."""
    forward = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    around = forward.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else forward
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = around.join(least, "u")
    moved = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else met.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.where("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """edges: rows (a long, b long). One row (node, component) for each node of an edge; component: the least node."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(most_rounds):
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == state:
            roots = now.select(F.col("b").alias("node")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
        state = (seen["n"], seen["h"])
        now = cut(_stars(_stars(now, large=True), large=False))
    raise RuntimeError(f"no fixed point of the components after {most_rounds} rounds")
