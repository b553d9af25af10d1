"""URL filter: a blocked Bloom filter in front of an exact hash join.

Rules name a host and a path prefix. A rule fits its host and all subdomains if the url's path
starts with the rule's path; the longest fitting rule decides. Each url yields the keys that a
rule could have (host suffixes by number of labels, path prefixes by length); the Bloom filter
drops nearly all keys that no rule has. Rows without a possible hit get the default verdict where they
are, without a shuffle. The possible hits alone, each with a row number of its own, go on to an equi-join
on the key text, which removes the filter's false positives, so a url that holds a large part of all
rows spreads like any other. The filter's size is capped, so it can be broadcast whatever the number of
rules: past the cap the filter only lets more keys through to the join, which stays exact.

Defined cases: a null url or one without ``://`` has an empty host and path, no rule, and the
default verdict. Equal rules with both verdicts count as block. Rules without a host fit nothing; without
rules every url gets the default. Urls may be of any length. Repeated rows and ties each get their row;
an empty table gives an empty result. Other columns travel in one struct, so their names cannot clash.
Row numbers follow the order of rows in a partition, which must be the same when a lost task is run
again, as that of files is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, looked_up, table, tidy

WORDS_PER_BLOCK = 8  # 64-bit words: one block is a cache line
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of op5, fixed by its contract: verdict, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def canonical_rules(rules: DataFrame) -> DataFrame:
    """One row (key, rule_verdict) for each listed host and path."""
    return (
        rules.where("host is not null and host <> ''")
        .select(F.concat(F.translate("host", UPPER, LOWER), F.coalesce("path", F.lit(""))).alias("key"), "verdict")
        .groupBy("key")
        .agg(F.max("verdict").alias("rule_verdict"))  # block sorts after allow
    )


class BlockedBloom:
    """A split-block Bloom filter: a key sets one bit in each word of one block."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.blocks = len(words) // WORDS_PER_BLOCK

    @staticmethod
    def blocks_for(keys: int, bits_per_key: int = 16, most_bytes: int = 4 << 20) -> int:
        return max(1, min(-(-keys * bits_per_key // 512), most_bytes // 64))

    @staticmethod
    def places(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """Word index and bit mask of each hash, one column for each word of its block."""
        h = hashes.astype(np.int64).view(np.uint64)
        block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
        mixed = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (h >> np.uint64(29))
        mixed = mixed * np.uint64(0xBF58476D1CE4E5B9)
        turns = np.arange(WORDS_PER_BLOCK, dtype=np.uint64)
        bits = (mixed[:, None] >> (np.uint64(16) + turns * np.uint64(6))) & np.uint64(63)
        return (block[:, None] * np.uint64(WORDS_PER_BLOCK) + turns).astype(np.int64), np.uint64(1) << bits

    @classmethod
    def build(cls, keys: DataFrame, column: str = "key", **size: int) -> BlockedBloom:
        """From a frame of distinct keys. Only the words that have a bit reach the driver: at most the capped size."""
        blocks = cls.blocks_for(keys.count(), **size)

        def parts(batches):
            for batch in batches:
                at, mask = cls.places(batch["h"].to_numpy(), blocks)
                yield pd.DataFrame({"at": at.ravel(), "mask": mask.view(np.int64).ravel()})

        words = np.zeros(blocks * WORDS_PER_BLOCK, dtype=np.uint64)
        hashed = keys.select(F.xxhash64(column).alias("h")).mapInPandas(parts, "at long, mask long")
        for row in hashed.groupBy("at").agg(F.bit_or("mask").alias("mask")).toLocalIterator():
            words[row["at"]] = np.uint64(row["mask"] & 0xFFFFFFFFFFFFFFFF)
        return cls(words)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        if not len(hashes):
            return np.zeros(0, dtype=bool)
        at, mask = self.places(hashes, self.blocks)
        return ((self.words[at] & mask) == mask).all(axis=1)


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow", column: str = "url") -> DataFrame:
    """One row (_row, host, path, rule, verdict) for each row; _row: it, as a struct."""
    spark = urls.sparkSession
    listed = cut(canonical_rules(rules))
    #: Label counts (a host has at most 127) and path lengths: short lists of numbers whatever the number of rules.
    host_part = F.regexp_extract("key", "^[^/]*", 0)
    sizes = listed.select(F.size(F.split(host_part, "\\.")).alias("labels"), (F.length("key") - F.length(host_part)).alias("chars")).distinct()
    found = sizes.agg(F.collect_set("labels").alias("labels"), F.collect_set("chars").alias("chars")).first()
    labels, chars = sorted(found["labels"]), sorted(found["chars"])
    bloom = spark.sparkContext.broadcast(BlockedBloom.build(listed).words)

    def possible_hits(batches):
        for batch in batches:
            keys, hashes = batch.column("keys"), batch.column("hashes")
            hit = BlockedBloom(bloom.value).has(hashes.flatten().to_numpy(zero_copy_only=False))
            ends = np.cumsum(np.concatenate([[0], hit]))[np.concatenate([[0], np.cumsum(hashes.value_lengths().to_numpy(zero_copy_only=False))])]
            hits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), keys.flatten().filter(pa.array(hit)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], hits], names=["_row", "host", "path", "hits"])

    host, path = host_and_path(F.col(column))
    split = urls.select(F.struct("*").alias("_row"), host.alias("host"), path.alias("path"))
    parts = F.split("host", "\\.")
    suffixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in labels]).cast("array<int>"), lambda n: (n <= F.size(parts)) & (F.col("host") != "")),
        lambda n: F.array_join(F.slice(parts, -n, n), "."),
    )
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in chars]).cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    keyed = split.withColumn("keys", keys).withColumn("hashes", F.transform("keys", lambda k: F.xxhash64(k)))
    tried = keyed.mapInArrow(tidy(possible_hits), T.StructType([*split.schema.fields, T.StructField("hits", T.ArrayType(T.StringType()))]))
    passed = tried.where(F.size("hits") == 0).select("_row", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    possible = tried.where(F.size("hits") > 0).withColumn("_number", F.monotonically_increasing_id()).select("_number", "_row", "host", "path", F.explode("hits").alias("key"))
    known = looked_up(possible, listed, ["key"], "left")
    order = F.when(F.col("rule_verdict").isNotNull(), F.struct(F.length("key"), F.length(F.regexp_extract("key", "^[^/]*", 0)), "key"))
    best = known.groupBy("_number").agg(*[F.first(c).alias(c) for c in ("_row", "host", "path")], F.max_by(F.struct("key", "rule_verdict"), order).alias("best"))
    return passed.unionByName(best.select("_row", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict")))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge(pages, rules).select("_row.page_id", "host", "path", "rule", "verdict")


OP5_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages
), split AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut
), ruled AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM split
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""
