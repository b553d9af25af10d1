"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a share of the words of the mix, so each of its documents an expected number of
copies: a whole part and a fractional chance. Dependent rounding settles the chances: two of them
exchange mass at random, keeping the words of the two together and the expectation of each, until
one is 0 or 1; the other goes on to the next document. So the words taken from a source miss its
target by less than one document, and each document keeps its chance.

The exchange is a reduction tree: leaves of a few thousand documents leave one unsettled document
each; those meet in nodes one level up, and so on to one for each source, settled by its chance.
A second pass over the leaves, told how the leaf's last document was settled, gives the copies.
All randomness is a hash of seed, source, document and place, so reruns agree, whatever the partitions.
Leaves are streamed in sorted order and hold one row, whatever their size. Rows fall into leaves by a hash
of all their columns, so rows of one id (or without one) spread; equal rows share a leaf, but for those
that fill more than one: they are numbered and dealt anew.

Targets are found by repeated sums over the table of sources: a source is capped once the level of those
not capped would lift it above its cap, until no more is. No step needs all sources in one task.

Defined cases: a null source is a source like others and comes last; a null or blank text has size
0 and is settled by chance alone; texts may be of any length; repeated rows are settled one by one, and
which of several equal rows is taken is left open; rows of equal size and id go by a hash of all columns;
an empty table gives an empty result; other columns travel in one struct, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.records import dense_index
from .common import cut, looked_up, row_hash, schema_of, table, tidy

MOST_BROADCAST_SOURCES = 100_000
NEAR = 1e-12
MASK = (1 << 64) - 1


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, ratio: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = (3, 1, 2)) -> DataFrame:
    """sizes: one row (source, source_size, n) for each source. Adds target: shares by weight, none above cap times its source, the excess reshared."""
    ranked = dense_index(sizes, [F.col("source").asc_nulls_last()])
    weighted = cut(ranked.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("row_index") % len(weights) + 1).cast("int"))).withColumn("_cap", F.col("source_size") * F.lit(cap)))
    total = (weighted.agg(F.sum("source_size")).first()[0] or 0) * ratio
    level, capped = 0.0, -1
    while True:  # the capped sources only grow in number, so this ends
        full = F.col("_cap") < level * F.col("_w") if capped >= 0 else F.lit(False)
        seen = weighted.agg(F.count_if(full).alias("capped"), F.sum(F.when(full, F.col("_cap")).otherwise(0.0)).alias("held"), F.sum(F.when(full, 0.0).otherwise(F.col("_w"))).alias("w")).first()
        if seen["capped"] == capped:
            break
        capped = seen["capped"]
        if not seen["w"]:
            level = math.inf
            break
        level = max(level, (total - seen["held"]) / seen["w"])
    target = F.col("_cap") if math.isinf(level) else F.least(F.col("_cap"), F.lit(level) * F.col("_w"))
    return weighted.select("source", "source_size", "n", target.alias("target"))


def _hash(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest())


def _random(h: int, place: int) -> float:
    x = (h + place * 0x9E3779B97F4A7C15) & MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return ((x ^ (x >> 31)) >> 11) / (1 << 53)


class Fold:
    """Settles a stream of (size, chance); at any time at most one is unsettled."""

    def __init__(self):
        self.size, self.chance, self.who, self.place = 0.0, 0.0, None, 0

    def add(self, who, size: float, chance: float, h: int) -> list[tuple[object, int]]:
        """Those that are settled now, with 0 or 1."""
        self.place += 1
        if chance <= NEAR or chance >= 1 - NEAR:
            return [(who, int(chance > 0.5))]
        u = _random(h, self.place)
        if size <= 0:
            return [(who, int(u < chance))]
        if self.who is None:
            self.who, self.size, self.chance = who, size, chance
            return []
        a, p, b, q = self.size, self.chance, size, chance
        up, down = min(1 - p, q * b / a), min(p, (1 - q) * b / a)
        move = up if u * (up + down) < down else -down
        p, q = p + move, q - move * a / b
        done = []
        left = None
        for w, s, c in ((self.who, a, p), (who, b, q)):
            if c <= NEAR or c >= 1 - NEAR:
                done.append((w, int(c > 0.5)))
            elif left is None:
                left = (w, s, c)
            else:  # rounding error left both inside: settle the later one
                done.append((w, int(c > 0.5)))
        self.who, self.size, self.chance = left or (None, 0.0, 0.0)
        return done


LEAF = ["_source", "_leaf"]


def _unsettled(batches):
    """What each leaf leaves over: one row at most. The rows come sorted by leaf."""
    leaf, fold = None, Fold()

    def left():
        return [(*leaf, fold.size, fold.chance)] if leaf is not None and fold.who is not None else []

    out: list[tuple] = []
    for batch in batches:
        for source, number, size, chance, h in zip(*[batch.column(c).to_pylist() for c in ("_source", "_leaf", "_size", "_chance", "_h")], strict=True):
            if leaf != (source, number):
                out += left()
                leaf, fold = (source, number), Fold()
            fold.add(0, size, chance, h)
        if len(out) > 10_000:
            yield _rows(out)
            out = []
    yield _rows(out + left())


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.float64(), pa.float64()), strict=True)], names=["_source", "_leaf", "_size", "_chance"])


def _settled(batches):
    """All rows with their copies; the first row of a leaf may tell how its last unsettled document ends."""
    leaf, fold, last = None, Fold(), 0
    held = None  # the unsettled row, if it came in an earlier batch
    kept = ["_row", "_size", "_source_size", "_target"]

    def give(rows: pa.RecordBatch, copies: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[rows.column(c) for c in kept], pa.array(copies, pa.int32())], names=[*kept, "_copies"])

    for batch in batches:
        n = batch.num_rows
        take: list[int | None] = [None] * n
        late: list[tuple[pa.RecordBatch, int]] = []

        def settle(done):
            for who, one in done:
                if who == "held":
                    late.append((held, one))
                else:
                    take[who] = one

        lists = [batch.column(c).to_pylist() for c in ("_source", "_leaf", "_kind", "_take", "_size", "_chance", "_h")]
        for i, (source, number, kind, told, size, chance, h) in enumerate(zip(*lists, strict=True)):
            if leaf != (source, number):
                if fold.who is not None:
                    settle([(fold.who, last)])
                leaf, fold, last = (source, number), Fold(), 0
            if kind == 0:
                last = told
            else:
                settle(fold.add(i, size, chance, h))
        rest = fold.who if isinstance(fold.who, int) else None
        for row, one in late:
            yield give(row, [one + row.column("_whole")[0].as_py()])
        whole = batch.column("_whole").to_pylist()
        out = [i for i in range(n) if lists[2][i] == 1 and take[i] is not None]
        if out:
            yield give(batch.take(pa.array(out, pa.int64())), [take[i] + whole[i] for i in out])
        if rest is not None:
            held, fold.who = batch.take(pa.array([rest], pa.int64())), "held"
    if fold.who is not None:
        yield give(held, [last + held.column("_whole")[0].as_py()])


def _resolve(left: DataFrame, fan: int, seed: int) -> DataFrame:
    """The tree above the leaves: (_source, _leaf, _take) for each unsettled document, level by level."""
    levels = []
    nodes = left.select("_source", F.col("_leaf").alias("_node"), "_size", "_chance")
    while True:
        most = nodes.agg(F.max("_node")).first()[0]
        if most is None:
            break
        nodes = nodes.withColumn("_up", F.floor(F.col("_node") / fan))

        top, level = most < fan, len(levels)

        def meet(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["_size", "_node"], ascending=[False, True])
            source = group["_source"].iloc[0]
            fold, take = Fold(), {}
            for n, size, chance in zip(group["_node"], group["_size"], group["_chance"], strict=True):
                take.update(fold.add(n, size, chance, _hash(seed, level, int(n), source)))
            if top and fold.who is not None:
                take[fold.who] = int(_random(_hash(seed, "top", len(group), source), fold.place + 1) < fold.chance)
                fold.who = None
            return pd.DataFrame({"_source": group["_source"], "_node": group["_node"], "_up": group["_up"], "_take": [take.get(n) for n in group["_node"]], "_size": group["_size"], "_chance": [fold.chance if n == fold.who else 0.0 for n in group["_node"]]}).astype({"_take": "Int32"})

        done = cut(nodes.groupBy("_source", "_up").applyInPandas(meet, "_source string, _node long, _up long, _take int, _size double, _chance double"))
        levels.append(done)
        if most < fan:
            break
        nodes = done.where("_take is null").select("_source", F.col("_up").alias("_node"), "_size", "_chance")
    if not levels:
        return left.select("_source", "_leaf", F.lit(0).alias("_take"))
    above = None
    for done in reversed(levels):
        here = done.select("_source", "_node", "_up", "_take")
        if above is not None:
            told = above.select(F.col("_source").alias("_s"), F.col("_node").alias("_n"), F.col("_take").alias("_told"))
            here = here.join(told, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_up") == F.col("_n")), "left").select("_source", "_node", "_up", F.coalesce("_take", "_told").alias("_take"))
        above = here
    return above.select("_source", F.col("_node").alias("_leaf"), "_take")


def _numbered(sized: DataFrame, per_leaf: int) -> DataFrame:
    """Rows that are equal and fill more than one leaf get hashes of their own for each per_leaf of them. As they are equal, it does not matter which row gets which."""
    hot = cut(sized.groupBy("_h").agg(F.count("*").alias("_c")).where(F.col("_c") > per_leaf).select("_h", F.lit(True).alias("_hot")))
    if hot.isEmpty():
        return sized
    marked = looked_up(sized, hot, ["_h"], "left")
    rows = cut(marked.where("_hot").drop("_hot").withColumn("_p", F.spark_partition_id()))
    # At most one row for each key and partition, so few enough for a window by key.
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_h").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy("_h", "_p").agg(F.count("*").alias("_n")).withColumn("_before", before).drop("_n")
    at = F.row_number().over(Window.partitionBy("_h", "_p").orderBy("_h")) - 1
    dealt = looked_up(rows.withColumn("_i", at), cut(starts), ["_h", "_p"]).withColumn("_h", F.xxhash64("_h", F.floor((F.col("_i") + F.col("_before")) / per_leaf)))
    return marked.where("_hot is null").select(*sized.columns).unionByName(dealt.select(*sized.columns))


def mix(df: DataFrame, size: Column, source: str = "source", ids: tuple[str, ...] = ("doc_id",), ratio: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = (3, 1, 2), per_leaf: int = 4096, fan: int = 4096, seed: int = 11) -> DataFrame:
    """One row for each input row: _row (it, as a struct), _size, _source_size, _target, _copies."""
    sized = df.select(F.struct("*").alias("_row"), F.col(source).cast("string").alias("_source"), size.cast("long").alias("_words"), F.xxhash64(F.struct(*[F.col(c) for c in ids]), row_hash(df), F.lit(seed)).alias("_h"))
    by_source = cut(targets(sized.groupBy(F.col("_source").alias("source")).agg(F.sum("_words").alias("source_size"), F.count("*").alias("n")), ratio, cap, weights))
    few = F.broadcast if by_source.count() <= MOST_BROADCAST_SOURCES else lambda x: x
    known = few(by_source.select(F.col("source").alias("_s"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.ceil(F.col("n") / per_leaf).alias("_leaves")))
    per_word = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)
    items = (
        _numbered(sized, per_leaf)
        .join(known, F.col("_source").eqNullSafe(F.col("_s")))
        .withColumn("_whole", F.floor(per_word + F.lit(NEAR)).cast("int"))
        .withColumn("_chance", F.greatest(F.lit(0.0), per_word - F.col("_whole")))
        .select("_row", "_source", F.pmod(F.xxhash64("_h", F.lit(seed + 1)), F.col("_leaves")).cast("long").alias("_leaf"), F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("_take"), F.col("_words").cast("double").alias("_size"), "_chance", "_whole", "_h", "_source_size", "_target")
    )

    def leaves(rows: DataFrame) -> DataFrame:
        return rows.repartition(*LEAF).sortWithinPartitions(*LEAF, "_kind", F.col("_size").desc(), "_h")

    lean = leaves(items.select(*LEAF, "_kind", "_size", "_chance", "_h")).select(*LEAF, "_size", "_chance", "_h")
    left = cut(lean.mapInArrow(tidy(_unsettled), "_source string, _leaf long, _size double, _chance double"))
    told = _resolve(left, fan, seed).withColumn("_kind", F.lit(0))
    both = leaves(items.unionByName(told, allowMissingColumns=True))
    return both.mapInArrow(tidy(_settled), schema_of(items, ["_row"], "_size double, _source_size long, _target double, _copies int"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix, each as often as it is taken, with the columns of docs."""
    found = mix(docs, words(F.col("text")), **options)
    return found.select(F.explode(F.array_repeat("_row", F.col("_copies"))).alias("_row")).select("_row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cut(table(spark, sf_dir, "documents").select("doc_id", "source", words(F.col("text")).alias("size")))  # words are counted once
    found = mix(docs, F.col("size"))
    return found.select("_row.doc_id", "_row.size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_row.size") * F.col("_copies")).cast("long").alias("taken"))
