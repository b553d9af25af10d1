"""Exact top-k inner products by pivot-table elimination.

Each vector's distances to a fixed set of pivots are computed once. By the triangle inequality
|d(q, p) - d(x, p)| is at most d(q, x) for each pivot p, so the largest of them bounds the distance
from below and the inner product (|q|^2 + |x|^2 - d(q, x)^2) / 2 from above.

1. Candidates are dealt into blocks of bounded size by their nearest pivot. Of each block the least and
   greatest distance to each pivot and the largest norm are kept: a few hundred bytes a block.
2. Each query is scored against a bounded sample of candidates, which gives a first k-th score. A block
   whose bound lies below it cannot hold a result, and the query isn't sent there.
3. Candidates move once, to their block; queries move to the blocks that are left. A task holds one block
   and streams its queries, however many there are. Candidates are evaluated in the order of their own
   bounds until the next bound is below the k-th score: what is left cannot enter the result, so it is
   exact. Only scores that reach the first k-th score leave the task.
4. The best k of each query over its blocks follow.

The work of a stated query set against all rows is at most their product, in tasks that more machines shorten.

Defined cases: a row whose id is null, or whose vector is null or holds null or non-finite
components, takes no part; vectors of unequal length are compared with zeros for what is missing;
equal scores go by the smaller id; a query never meets a row of its own id; repeated candidates
count as often as they occur; the rows of a query id that occurs several times each bring their scores,
and the best k of all are ranked; fewer candidates than k give fewer rows; an empty table gives an empty
result; components and scores beyond 64 bits are cut to the nearest that fits; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, table, tidy

LONG = 1 << 63
EXACT = float(1 << 53)  # whole numbers below it are exact as doubles


def floored(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null where the vector takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of a list array, with zeros for what is missing."""
    flat, sizes = vectors.flatten().to_numpy(zero_copy_only=False), vectors.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first points of a bounded sample."""
    points = sample.astype(np.float64)
    if not len(points):
        return points
    at = [0]
    nearest = ((points - points[0]) ** 2).sum(axis=1)
    while len(at) < min(n, len(points)) and nearest.max() > 0:
        at.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((points - points[at[-1]]) ** 2).sum(axis=1))
    return points[at]


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    squares = (x * x).sum(axis=1)[:, None] - 2.0 * x @ pivots.T + (pivots * pivots).sum(axis=1)
    return np.sqrt(np.maximum(squares, 0.0))


def search(queries: np.ndarray, query_ids: np.ndarray, query_at: np.ndarray, least: np.ndarray, vectors: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int) -> tuple[list[int], list[int], list[int], int]:
    """Row of the query, id and score of its best k among the vectors, and how many were evaluated. *_at: distances to the pivots. least: a score for each query below which nothing counts."""
    largest = max(float(np.abs(vectors).max(initial=0)), float(np.abs(queries).max(initial=0)), 1.0)
    exact = largest * largest * vectors.shape[1] < EXACT
    x, q = (vectors.astype(np.float64), queries.astype(np.float64)) if exact else (vectors.astype(object), queries.astype(object))
    norms = (vectors.astype(np.float64) ** 2).sum(axis=1)
    by_pivot = np.ascontiguousarray(at.T, dtype=np.float32)
    slack = slack_of(at, query_at)
    lower, gap = np.empty(len(ids), np.float32), np.empty(len(ids), np.float32)
    rows, found, scores, evaluated = [], [], [], 0
    for i, own in enumerate(query_ids):
        lower[:] = 0
        for p, d in enumerate(query_at[i].astype(np.float32)):
            np.subtract(by_pivot[p], d, out=gap)
            np.abs(gap, out=gap)
            np.maximum(lower, gap, out=lower)
        apart = np.maximum(lower - slack, 0).astype(np.float64)
        bound = loosened(((queries[i].astype(np.float64) ** 2).sum() + norms - apart * apart) / 2)
        bound[ids == own] = -np.inf
        best = np.zeros(0, dtype=x.dtype)
        which = np.zeros(0, dtype=np.int64)
        floor = float(least[i])
        left = np.flatnonzero((bound > -np.inf) & (bound >= floor))
        chunk = max(4 * k, 64)
        while len(left):
            if len(left) > chunk:
                parted = np.argpartition(-bound[left], chunk)
                now, left = left[parted[:chunk]], left[parted[chunk:]]
            else:
                now, left = left, left[:0]
            evaluated += len(now)
            which = np.concatenate([which, now])
            best = np.concatenate([best, x[now] @ q[i]])
            order = np.lexsort((ids[which], -best))[:k]
            which, best = which[order], best[order]
            if len(best) == k and len(left):
                left = left[bound[left] >= max(floor, float(best[-1]))]  # exact stopping: ties may still win by id
            chunk *= 8
        good = best.astype(np.float64) >= floor
        rows += [i] * int(good.sum())
        found += ids[which[good]].tolist()
        scores += [min(max(int(s), -LONG), LONG - 1) for s in best[good]]
    return rows, found, scores, evaluated


def slack_of(*at: np.ndarray) -> np.float32:
    """More than the rounding of distances."""
    return np.float32(max(float(x.max(initial=0)) for x in at) * 1e-5 + 1e-3)


def loosened(bound: np.ndarray) -> np.ndarray:
    return bound + np.abs(bound) * 1e-9 + 1e-6


def first_scores(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """For each query a score that its k-th best is sure to reach: the k-th best among some candidates, less what rounding may be."""
    if len(ids) <= k:
        return np.full(len(queries), -np.inf)
    scores = queries.astype(np.float64) @ vectors.astype(np.float64).T
    scores[query_ids[:, None] == ids[None, :]] = -np.inf
    kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    largest = np.abs(queries).max(axis=1, initial=0).astype(np.float64) * np.abs(vectors).max(initial=0) * max(1, vectors.shape[1])
    return kth - largest * 1e-9 - 1e-3


@dataclass(frozen=True)
class Blocks:
    """What is known of each block: number, least and greatest distance to each pivot, largest squared norm."""

    numbers: np.ndarray
    nearest: np.ndarray
    farthest: np.ndarray
    norm: np.ndarray

    def bounds(self, query: np.ndarray, at: np.ndarray, slack: np.float32) -> np.ndarray:
        """For each block the greatest score that any of its rows may have with the query."""
        apart = np.maximum(np.maximum(self.nearest - at, at - self.farthest).max(axis=1, initial=0) - slack, 0).astype(np.float64)
        return loosened(((query.astype(np.float64) ** 2).sum() + self.norm - apart * apart) / 2)


def _near(width: int, points: np.ndarray):
    """Adds distances to the pivots, the nearest pivot and the squared norm."""

    def run(batches):
        for batch in batches:
            x = matrix(batch.column("vector"), width)
            at = distances(x, points).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * len(points)), pa.array(at.ravel()))
            columns = [batch.column("id"), batch.column("vector"), lists, pa.array(at.argmin(axis=1).astype(np.int32)), pa.array((x.astype(np.float64) ** 2).sum(axis=1))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "vector", "at", "pivot", "norm"])

    return run


def _sent(width: int, k: int, told):
    """Each query once for each block that may hold a result, with its first k-th score."""

    def run(batches):
        blocks, vectors, ids = told.value
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                few = batch.slice(low, 1024)
                q, at, own = matrix(few.column("vector"), width), few.column("at").flatten().to_numpy().reshape(few.num_rows, -1), few.column("id").to_numpy()
                least = first_scores(q, own, vectors, ids, k)
                slack = slack_of(at, blocks.farthest)
                to = [blocks.numbers[blocks.bounds(v, a, slack) >= f] for v, a, f in zip(q, at, least, strict=True)]
                row = pa.array(np.repeat(np.arange(len(to)), [len(t) for t in to]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int32), *to])), *[few.column(c).take(row) for c in ("id", "vector", "at")], pa.array(least).take(row)], names=["block", "id", "vector", "at", "least"])

    return run


def _met(width: int, k: int, evaluated):
    """Rows come sorted by block, candidates before queries: a block is held, its queries are streamed."""

    def run(batches):
        block, held, built = None, [], None
        for batch in batches:
            numbers, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(kinds) != 0)) + 1
            for low, high in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if low == high:
                    continue
                if numbers[low] != block:
                    block, held, built = numbers[low], [], None
                part = batch.slice(low, high - low)
                if kinds[low] == 0:
                    held.append(part.select(["id", "vector", "at"]))
                    continue
                if not held:
                    continue
                if built is None:
                    xs = pa.Table.from_batches(held).combine_chunks()
                    built = [matrix(xs["vector"].chunk(0), width), xs["id"].to_numpy(), xs["at"].chunk(0).flatten().to_numpy().reshape(len(xs), -1)]
                for at in range(0, part.num_rows, 512):
                    qs = part.slice(at, 512)
                    own = qs.column("id").to_numpy()
                    rows, ids, scores, n = search(matrix(qs.column("vector"), width), own, qs.column("at").flatten().to_numpy().reshape(len(own), -1), qs.column("least").to_numpy(), *built, k)
                    if evaluated is not None:
                        evaluated.add(n)
                    yield pa.RecordBatch.from_arrays([pa.array(own[rows], pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], names=["query_id", "vec_id", "score"])

    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int, pivots: int = 64, sample: int = 2048, block: int = 32_768, seed: int = 5, evaluated=None) -> DataFrame:
    """candidates, queries: rows (id long, vector array<long>). One row (query_id, rank, vec_id, score) for each query and rank.

    sample: candidates that pivots and first scores are taken from. block: candidates in one task. evaluated: an accumulator for the number of scores computed.
    """
    usable = F.col("id").isNotNull() & F.col("vector").isNotNull()
    every, asked = candidates.where(usable).select("id", "vector"), queries.where(usable).select("id", "vector")
    width = max(df.agg(F.max(F.size("vector"))).first()[0] or 0 for df in (every, asked))
    drawn = every.orderBy(F.xxhash64("id", F.lit(seed)), "id", "vector").limit(sample).toPandas()
    vectors, ids = matrix(pa.array(drawn["vector"].tolist(), pa.list_(pa.int64())), width), drawn["id"].to_numpy(dtype=np.int64)
    points = choose_pivots(vectors, pivots)
    if not len(points):
        points = np.zeros((1, width))
    spec = "id long, vector array<bigint>, at array<float>, pivot int, norm double"
    near = cut(every.mapInArrow(tidy(_near(width, points)), spec))
    counts = {r["pivot"]: r["n"] for r in near.groupBy("pivot").agg(F.count("*").alias("n")).collect()}  # one row for each pivot
    parts, before = {}, 0
    for pivot, n in sorted(counts.items()):
        parts[pivot] = (before, -(-n // block))
        before += parts[pivot][1]
    known = F.create_map(*[x for p, (b, n) in parts.items() for x in (F.lit(p), F.struct(F.lit(b).alias("before"), F.lit(n).alias("parts")))]) if parts else F.lit(None).cast("map<int,struct<before:int,parts:int>>")
    # Rows of one id spread too: the number of a checkpointed row is the same each time it is read.
    dealt = near.withColumn("_p", known[F.col("pivot")]).withColumn("block", (F.col("_p.before") + F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.col("_p.parts"))).cast("int"))
    edges = [f(F.col("at")[i]).alias(f"{n}{i}") for n, f in (("a", F.min), ("z", F.max)) for i in range(len(points))]
    seen = dealt.groupBy("block").agg(F.max("norm").alias("norm"), *edges).toPandas()  # one row for each block candidates
    blocks = Blocks(seen["block"].to_numpy(dtype=np.int32), *(seen[[f"{n}{i}" for i in range(len(points))]].to_numpy(dtype=np.float32) for n in "az"), seen["norm"].to_numpy(dtype=np.float64))
    told = every.sparkSession.sparkContext.broadcast((blocks, vectors, ids))
    sent = asked.mapInArrow(tidy(_near(width, points)), spec).mapInArrow(tidy(_sent(width, k, told)), "block int, id long, vector array<bigint>, at array<float>, least double")
    both = dealt.select("block", F.lit(0).alias("kind"), "id", "vector", "at", F.lit(None).cast("double").alias("least")).unionByName(sent.withColumn("kind", F.lit(1)))
    met = both.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(tidy(_met(width, k, evaluated)), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), floored(F.col("embedding")).alias("vector"))
    return top_k(rows, rows.where("id % 50 = 0"), 5)


OP3_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score
  FROM whole q JOIN whole x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""
