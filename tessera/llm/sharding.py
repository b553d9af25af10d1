"""Sharding by sampled splitters, with sizes near equal.

Records are ordered by a hash of their text, so equal texts lie together. Sizes are first added up
for each key, so a hot group of copies is one row from there on. A size-weighted sample of keys
gives quantile boundaries; a key that alone outweighs a range gets a range of its own, divided by
a second hash, and ranges that turn out overfull in an exact count are divided at boundaries from a
further sample. Ranges then go to shards in order, by exact sizes.

The driver sees sampled keys, heavy keys and one row for each range: all bounded by the number of
ranges, which is fixed for each shard, whatever the number of rows. Slots are numbered within buckets of
a range that hold about as many rows as a parameter says, after those of the buckets before, so no task
numbers a whole shard.

Defined cases: a null text counts as an empty one; texts may be of any length; a null id is a value like
others; repeated rows each get a slot, and equal keys and ids are ties that the bucket and input partition
order; an empty table gives an empty result; other columns of the frame are kept, but columns named shard
or slot are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, free_name, looked_up, table, unit


@dataclass(frozen=True)
class Splitters:
    """starts: the first key of each range; parts: into how many parts each is divided by the second hash."""

    starts: np.ndarray
    parts: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """The number of the first part of each range."""
        return np.concatenate([[0], np.cumsum(self.parts)[:-1]])

    def locate(self, keys: np.ndarray, second: np.ndarray) -> np.ndarray:
        at = np.maximum(np.searchsorted(self.starts, keys, side="right") - 1, 0)
        return self.first[at] + np.minimum((second * self.parts[at]).astype(np.int64), self.parts[at] - 1)


def _sample(weights: DataFrame, rate: float, seed: int, round_: int) -> list[tuple[int, float]]:
    """Keys drawn with a chance in proportion to their size; a heavy key is drawn for sure and stands for its own size."""
    chance = F.least(F.lit(1.0), F.col("w") * rate)
    rows = weights.where(unit(F.col("k"), F.lit(seed), F.lit(round_)) < chance).select("k", F.greatest(F.col("w") * rate, F.lit(1.0)).alias("n"))
    return sorted((r["k"], r["n"]) for r in rows.collect())


def _quantiles(sample: list[tuple[int, float]], n: int) -> list[int]:
    if not sample:
        return []
    keys, stands = (np.array(x) for x in zip(*sample, strict=True))
    ends = np.cumsum(stands)
    return sorted({int(keys[min(np.searchsorted(ends, ends[-1] * i / n, side="left"), len(keys) - 1)]) for i in range(1, n)})


def sampled_splitters(weights: DataFrame, total: int, ranges: int, per_range: int = 16, seed: int = 7) -> Splitters:
    """weights: one row (k long, w long of at least 1) for each distinct key. total: the sum of w. ranges: about how many to make.

    Overfull ranges are sampled again, four times as densely in each round. Once every key of such a range is
    drawn for sure, its boundaries are exact, so this ends, after a few rounds.
    """
    most = max(1.0, 2.0 * total / ranges)
    heavy = {r["k"]: r["w"] for r in weights.where(F.col("w") > most).collect()}  # at most ranges / 2
    starts = {-(1 << 63), *_quantiles(_sample(weights, ranges * per_range / max(total, 1), seed, 0), ranges)}
    for k in heavy:
        starts |= {k} | ({k + 1} if k + 1 < 1 << 63 else set())
    rate, round_ = per_range * ranges / max(total, 1), 0
    while rate < 1.0:
        order = np.array(sorted(starts), dtype=np.int64)
        at = _locator(Splitters(order, np.ones(len(order), dtype=np.int64)))
        light = weights.where(~F.col("k").isin(list(heavy))) if heavy else weights
        placed = light.withColumn("r", at(F.col("k"), F.lit(0.0)))
        over = {r["r"]: r["w"] for r in placed.groupBy("r").agg(F.sum("w").alias("w")).where(F.col("w") > most).collect()}
        if not over:
            break
        rate, round_ = min(rate * 4, 1.0), round_ + 1
        rows: dict[int, list[tuple[int, float]]] = {}
        for k, n in _sample(placed.where(F.col("r").isin(list(over))).select("k", "w"), rate, seed, round_):
            rows.setdefault(int(np.searchsorted(order, k, side="right") - 1), []).append((k, n))
        starts |= {x for r, s in rows.items() for x in _quantiles(s, int(-(-over.get(r, most) // most)) * 2)}
    order = np.array(sorted(starts), dtype=np.int64)
    return Splitters(order, np.array([-(-heavy.get(int(k), 1) // int(most)) if int(k) in heavy else 1 for k in order], dtype=np.int64))


def _locator(splitters: Splitters):
    @F.pandas_udf("long")
    def locate(keys: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series(splitters.locate(keys.to_numpy(), second.to_numpy()))

    return locate


def assign_shards(df: DataFrame, shards: int, size: str, key: str, ids: list[str], per_shard: int = 40, per_bucket: int = 500_000, seed: int = 7) -> DataFrame:
    """Adds shard and slot (gapless from 0 in each shard) to the rows. size: a long column of at least 1; key: a long column, equal for rows to be kept together; ids: columns that order the rows of a key. The rows are checkpointed, so pass what is needed to tell them apart rather than whole texts."""
    df = df.drop("shard", "slot")
    spark = df.sparkSession
    range_, second, bucket, from_ = (free_name(df, c) for c in ("_range", "_second", "_bucket", "_from"))
    weights = cut(df.groupBy(F.col(key).alias("k")).agg(F.sum(size).alias("w")))
    total = weights.agg(F.sum("w").alias("w")).first()["w"] or 0
    splitters = sampled_splitters(weights, total, shards * per_shard, seed=seed)
    #: Repeated rows that nothing tells apart still spread, by the input partition they are in.
    spread = unit(*[F.col(c) for c in ids], F.spark_partition_id(), F.lit(seed))
    placed = cut(df.withColumn(second, spread).withColumn(range_, _locator(splitters)(F.col(key), F.col(second))))  # counted and numbered alike
    held = sorted((r[range_], r["w"], r["n"]) for r in placed.groupBy(range_).agg(F.sum(size).alias("w"), F.count("*").alias("n")).collect())
    layout, before, filled = [], 0, [0] * shards
    for r, w, n in held:
        shard = min(shards - 1, (2 * before + w) * shards // (2 * total))
        layout.append((r, shard, filled[shard], -(-n // per_bucket)))
        before += w
        filled[shard] += n
    places = F.broadcast(spark.createDataFrame(layout, f"{range_} long, shard int, {from_} long, _buckets long"))  # one row for each range
    dealt = placed.join(places, range_).withColumn(bucket, F.pmod(F.xxhash64(F.col(key), F.col(second), F.lit(seed)), F.col("_buckets"))).drop("_buckets")
    at = F.row_number().over(Window.partitionBy(range_, bucket).orderBy(key, *ids, second)).cast("long") - 1
    if max((b for *_, b in layout), default=1) > 1:
        sizes = dealt.groupBy(range_, bucket).agg(F.count("*").alias("_n"))
        first = F.coalesce(F.sum("_n").over(Window.partitionBy(range_).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        dealt = looked_up(dealt, cut(sizes.withColumn("_first", first).drop("_n")), [range_, bucket])
        return dealt.withColumn("slot", at + F.col(from_) + F.col("_first")).drop(range_, second, from_, bucket, "_first")
    return dealt.withColumn("slot", at + F.col(from_)).drop(range_, second, from_, bucket)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    lean = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"))
    return assign_shards(lean, 16, "size", "key", ["doc_id"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
