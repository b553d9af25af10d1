"""Joins with the checks and orders that measurements need."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {missing}")
    return df


def asserted(df: DataFrame, broken: Column, message: str) -> DataFrame:
    """Raises when a row is broken, as part of the query itself."""
    keep = F.when(broken, F.raise_error(F.lit(message)).cast("boolean")).otherwise(True)
    return df.where(keep)


def unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raises on repeated keys; the check shares the shuffle of a later join on them."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return asserted(df.withColumn("_n", n), F.col("_n") > 1, f"repeated keys: {list(keys)}").drop("_n")


def one_to_one(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An inner join of unique keys where every key of either side is met."""
    left, right = unique(a, keys).withColumn("_l", F.lit(1)), unique(b, keys).withColumn("_r", F.lit(1))
    both = left.join(right, [*keys], "full_outer")
    return asserted(both, F.col("_l").isNull() | F.col("_r").isNull(), "a key has no partner").drop("_l", "_r")


def key_differences(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of one side alone, with the side; repeats count (EXCEPT ALL both ways)."""
    left, right = a.select(*keys), b.select(*keys)
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def paired_roles(rows: DataFrame, keys: Sequence[str], order: str, value: str, role: str = "role", roles: Sequence[str] = ("chosen", "rejected")) -> DataFrame:
    """Separately stored halves paired again: the k-th of one role with the k-th of the other; halves left over are dropped."""
    kth = F.row_number().over(Window.partitionBy(*keys, role).orderBy(order))
    out = rows.where(F.col(role).isin(*roles)).withColumn("k", kth).groupBy(*keys, "k").agg(*[F.max(F.when(F.col(role) == r, F.col(value))).alias(r) for r in roles], F.count_distinct(role).alias("_n"))
    return out.where(F.col("_n") == len(roles)).drop("_n")


def matched_effects(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, fill: float | None = None) -> DataFrame:
    """The same units at two stages: value at each and the difference. With fill, a missing value counts as that; without, keys must be unique."""
    if fill is None:
        a, b = unique(a, keys), unique(b, keys)
    left, right = (df.select(*keys, (F.coalesce(value, F.lit(fill)) if fill is not None else F.col(value)).alias(n)) for df, n in ((a, "before"), (b, "after")))
    return left.join(right, [*keys]).withColumn("delta", F.col("after") - F.col("before"))


def labelled_by_any_id(facts: DataFrame, ids: Sequence[str], labels: DataFrame, label: str, default: str) -> DataFrame:
    """The label of the first id column that has one (labels: id, label, written; the later row wins), else the default."""
    known = labels.groupBy("id").agg(F.max_by(label, "written").alias(label))
    out = facts
    for i, c in enumerate(ids):
        out = out.join(known.select(F.col("id").alias(c), F.col(label).alias(f"_l{i}")), c, "left")
    found = F.coalesce(*[F.col(f"_l{i}") for i in range(len(ids))])
    return out.withColumn("matched", found.isNotNull()).withColumn(label, F.coalesce(found, F.lit(default))).drop(*[f"_l{i}" for i in range(len(ids))])


def exact_else_proxy(sources: DataFrame, exact: DataFrame, proxy: DataFrame) -> DataFrame:
    """Sources mapped by the exact table, and only what that lacks by the proxy table."""
    first = sources.join(exact, "source").withColumn("exact", F.lit(True))
    rest = sources.join(exact.select("source"), "source", "left_anti").join(proxy, "source").withColumn("exact", F.lit(False))
    return first.unionByName(rest)


def first_with_all(rows: DataFrame, base: str, role: str, first_role: str, order: str) -> DataFrame:
    """Of each base document the first row of one role with every row of the others."""
    cols = [c for c in rows.columns if c not in (base, role)]
    first = rows.where(F.col(role) == first_role).groupBy(base).agg(F.min_by(F.struct(*cols), order).alias("first"))
    return rows.where(F.col(role) != first_role).join(first, base).select(base, F.col("first")[order].alias(f"first_{order}"), *cols)


def parallel_pairs(rows: DataFrame, base: str, role: str, roles: tuple[str, str], within: Sequence[str], value: str) -> DataFrame:
    """The two roles' texts of each base document and author."""
    sides = [rows.where(F.col(role) == r).select(base, *within, F.col(value).alias(r)) for r in roles]
    return sides[0].join(sides[1], [base, *within])


def consumed_once(new: DataFrame, old: DataFrame, passes: Sequence[Sequence[str]], new_id: str, old_id: str) -> DataFrame:
    """New rows matched with old ones, each old row once: by the first keys, and what is left by the next ones. Rows of equal keys are matched in id order."""
    out = None
    for number, keys in enumerate(passes):
        order = {new_id: Window.partitionBy(*keys).orderBy(new_id), old_id: Window.partitionBy(*keys).orderBy(old_id)}
        left = new.select(new_id, *keys).withColumn("_k", F.row_number().over(order[new_id]))
        right = old.select(old_id, *keys).withColumn("_k", F.row_number().over(order[old_id]))
        met = left.join(right, [*keys, "_k"]).select(new_id, old_id, F.lit(number).alias("pass"))
        out = met if out is None else out.unionByName(met)
        new, old = new.join(met, new_id, "left_anti"), old.join(met, old_id, "left_anti")
    return out


def ranges(points: DataFrame, spans: DataFrame, point: str, low: str, high: str, width: int) -> DataFrame:
    """Points within half-open spans, as an equi-join on buckets of a width: no cross join."""
    cut = lambda c: F.floor(c / F.lit(width))
    spread = spans.where(F.col(low) < F.col(high)).withColumn("_b", F.explode(F.sequence(cut(F.col(low)), cut(F.col(high) - 1))))
    return points.withColumn("_b", cut(F.col(point))).join(spread, "_b").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_b")


def role_map(rows: DataFrame, base: str, role: str, value: str, order: str) -> DataFrame:
    """One map of role to value for each base document; the last row of a role wins."""
    last = rows.groupBy(base, role).agg(F.max_by(value, order).alias(value))
    return last.groupBy(base).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(role, value)))).alias("by_role"))


def in_all(rows: DataFrame, node: str, group: str, value: str, score: str, order: Column | None = None) -> DataFrame:
    """Groups that have every node: the best value of each node, and the sum of its absolute scores. Best is by absolute score, or by order where that is given; of equals the greater value."""
    by = F.abs(score) if order is None else order
    nodes = rows.agg(F.count_distinct(node).alias("_nodes"))
    best = rows.groupBy(group, node).agg(F.max_by(value, F.struct(by, F.col(value))).alias(value), F.max(F.abs(score)).alias("_s"))
    out = best.groupBy(group).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(node, value))), lambda x: x[value].cast("string")), ";").alias("chosen"), F.sum("_s").alias("total"))
    return out.join(F.broadcast(nodes), F.col("n") == F.col("_nodes")).drop("_nodes")  # one row


def complete_groups(rows: DataFrame, group: str, member: str, members: Sequence[str], size: str, most: int) -> DataFrame:
    """groups with every expected member and no size above the cap."""
    out = rows.groupBy(group).agg(F.collect_set(member).alias("_m"), F.max(size).alias("largest"))
    return out.where((F.size(F.array_intersect("_m", F.array(*[F.lit(m) for m in members]))) == len(set(members))) & (F.col("largest") <= most)).drop("_m")


def union_last(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both with all columns of either; of equal keys the new row. A new row marked deleted removes its key."""
    both = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)), allowMissingColumns=True)
    cols = [c for c in both.columns if c != "_n"]
    out = both.groupBy(*keys).agg(F.max_by(F.struct(*cols), "_n").alias("_r")).select("_r.*")
    return out.where(~F.coalesce("deleted", F.lit(False))).drop("deleted") if "deleted" in cols else out
