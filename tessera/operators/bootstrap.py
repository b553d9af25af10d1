"""Q4, Q6 to Q8: bootstraps that draw exactly as many clusters as a cell has, as multinomial counts down a tree.

A cell's clusters fall into leaves of about 4,096 by a hash. A replicate's n draws are split binomially from the root down
by how many clusters lie on each side, then dealt evenly within the leaf; together that is one multinomial
draw. Each leaf walks its own path, and nodes have random numbers of their own, so leaves that share a node agree on it
without meeting: clusters move once, whatever the number of replicates, and a leaf sends a row for each replicate.

Rows of one cluster are summed first, so every different value, null too, is one cluster. Null sums are 0. Reruns
and other partitions give the same draws; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut

LEAF = 4096
#: Cells (two numbers each) that are sent to all tasks; with more, clusters meet their cell in so many parts.
FEW_CELLS, SALTS = 500_000, 64


def leaves(clusters: DataFrame, keys: Sequence[str], cluster: str, sums: Sequence[str], leaf: int = LEAF) -> DataFrame:
    """keys, _cell (their hash), _path (level, prefix, left and all clusters of each node from the root down), and the leaf's _rows sorted by cluster."""
    one = clusters.groupBy(*keys, cluster).agg(*[F.coalesce(F.sum(s), F.lit(0)).cast("double").alias(s) for s in sums])
    one = one.withColumns({"_cell": F.xxhash64(F.lit(0), *[F.col(k).cast("string") for k in keys], *[F.col(k).isNull() for k in keys]), "_h": F.xxhash64(F.col(cluster).cast("string"), F.col(cluster).isNull())})
    one = cut(one)  # one row a cluster, read several times below
    depth = F.greatest(F.lit(0), F.ceil(F.log2(F.col("_n") / float(leaf)))).cast("int")
    cells = cut(one.groupBy("_cell").agg(F.count("*").alias("_n")).select("_cell", depth.alias("_depth")))
    if cells.count() <= FEW_CELLS:
        met = one.join(F.broadcast(cells), "_cell")
    else:  # a cell may hold a third of all clusters, so they don't meet their cell in one task
        salted = cells.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = one.withColumn("_salt", F.pmod("_h", F.lit(SALTS)).cast("int")).join(salted, ["_cell", "_salt"]).drop("_salt")
    # The first bits of the hash; a shift by 64 is a shift by none.
    placed = met.withColumn("_leaf", F.when(F.col("_depth") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftrightunsigned(_h, 64 - _depth)")))
    row = F.struct(F.col(cluster).cast("string").alias("c"), F.array(*sums).alias("s"))
    grouped = placed.groupBy("_cell", "_depth", "_leaf", *keys).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    sizes = placed.groupBy("_cell", "_depth", "_leaf").agg(F.count("*").alias("n"))
    steps = F.transform(F.sequence(F.lit(0), F.col("_depth")), lambda level: F.struct(level.alias("level"), F.call_function("shiftright", F.col("_leaf"), F.col("_depth") - level).alias("prefix")))
    by_node = sizes.select("_cell", "_depth", "_leaf", "n", F.explode(steps).alias("x")).select("_cell", "_depth", "_leaf", "n", "x.*")
    nodes = by_node.groupBy("_cell", "level", "prefix").agg(F.sum("n").alias("size"))
    # What a node has on its left is the size of its child with an even prefix, 0 where that one is empty.
    left = nodes.where((F.col("level") > 0) & (F.col("prefix") % 2 == 0)).select("_cell", (F.col("level") - 1).alias("level"), F.call_function("shiftright", "prefix", F.lit(1)).alias("prefix"), F.col("size").alias("left"))
    split = nodes.join(left, ["_cell", "level", "prefix"], "left").withColumn("left", F.coalesce("left", F.lit(0)))
    path = by_node.join(split, ["_cell", "level", "prefix"]).groupBy("_cell", "_leaf").agg(F.array_sort(F.collect_list(F.struct("level", "prefix", "left", "size"))).alias("_path"))
    return grouped.join(path, ["_cell", "_leaf"])


def _drawn(path: list, rows: np.ndarray, cell: int, replicates: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """How many draws of each replicate reach the leaf, and its sums over them."""
    mask = (1 << 64) - 1
    reach = np.full(replicates, path[0]["size"], np.int64)
    for node, child in zip(path, path[1:], strict=False):
        rng = np.random.default_rng([seed, cell & mask, node["level"], node["prefix"]])
        lefts = rng.binomial(reach, node["left"] / node["size"])
        reach = reach - lefts if child["prefix"] % 2 else lefts
    rng = np.random.default_rng([seed, cell & mask, path[-1]["level"], path[-1]["prefix"], 1])
    n = len(rows)
    out = np.empty((replicates, rows.shape[1]))
    for start in range(0, replicates, 64):
        out[start : start + 64] = rng.multinomial(reach[start : start + 64], np.full(n, 1.0 / n)) @ rows
    return reach, out


def redrawn(clusters: DataFrame, keys: Sequence[str], cluster: str, sums: Sequence[str], replicates: int = 200, seed: int = 13, leaf: int = LEAF) -> DataFrame:
    """keys, replicate, draws (always the cell's number of clusters) and the sums over the drawn clusters, as doubles."""
    if not sums or replicates < 1:
        raise ValueError("give sums and at least one replicate")
    made = leaves(clusters, keys, cluster, sums, leaf).select(*keys, "_cell", "_path", "_rows")
    kinds = "".join(f"`{k}` {made.schema[k].dataType.simpleString()}, " for k in keys)
    width = len(sums)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(len(pdf)):
                one = pdf.iloc[[i]]
                rows = np.array([np.asarray(r["s"], float) for r in one["_rows"].iloc[0]]).reshape(-1, width)
                reach, out = _drawn(list(one["_path"].iloc[0]), rows, int(one["_cell"].iloc[0]), replicates, seed)
                repeated = one[list(keys)].loc[one.index.repeat(replicates)].reset_index(drop=True)
                yield repeated.assign(replicate=np.arange(replicates, dtype=np.int32), draws=reach, _x=list(out))

    # Few leaves to a batch: a row holds thousands of clusters.
    per_leaf = made.mapInPandas(draw, f"{kinds}replicate int, draws long, _x array<double>")
    return per_leaf.groupBy(*keys, "replicate").agg(F.sum("draws").alias("draws"), *[F.sum(F.col("_x")[i]).alias(s) for i, s in enumerate(sums)])


def difference(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> tuple[Column, Column]:
    """The conservative interval of a - b: from the least of a less the most of b to the most of a less the least of b."""
    return low_a - high_b, high_a - low_b
