"""Embedding whitening: covariance by one aggregation of generated column sums, decomposed with LAPACK.

Vectors are put on a grid of whole numbers, x = floor(64 * c) + 1000000 for each entry c. The fit list holds
each different x-vector once; equal vectors are brought together by a hash aggregation that first merges them
within each task, so a vector that a third of the rows hold moves once for each task. One aggregation gives n
and the sum of each dimension, a second one the sum of the products of centred values for every pair of
dimensions in the upper triangle, each a generated SQL expression. Its result is one row of d * (d + 1) / 2
numbers, whatever the number of vectors; only that row comes to the driver, where the covariance is assembled
and decomposed. Rows are then projected by generated expressions as well; nothing is shuffled for that, and
all stays in the JVM. For more pairs than PAIRS_AT_ONCE (from 91 dimensions on) there are several aggregations
over the checkpointed list, as one can't hold that many expressions.

Defined cases: rows whose vector is null, empty or holds null or non-finite entries take no part and get no
rows. Rows of another number of dimensions than most rows that take part have (of equally frequent ones, the
greatest) take no part either. Repeated rows get rows each by itself, null ids too. A component
without variance beyond rounding (RANK of the greatest eigenvalue) can't be whitened: its ``whitened`` is null
and identity_error leaves it out; with a single fitted vector that holds for all, and explained is null then.
Empty tables give no rows. Other columns are ignored or, where named in ``kept``, passed on, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Sums that one aggregation computes.
PAIRS_AT_ONCE = 4096
#: Eigenvalues up to this share of the greatest count as none.
RANK = 1e-12


@dataclass
class Whitening:
    """What was fitted: n vectors, sums and ranges by dimension, components as rows by falling eigenvalue."""

    n: int
    sums: list[int]
    spread: int
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def dims(self) -> int:
        return len(self.sums)

    def alive(self, i: int) -> bool:
        return bool(self.values[i] > RANK * max(self.values[0], 0.0))


def gridded(vectors: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """All columns in ``_row`` and the whole numbers ``x`` of the rows that take part, and their number of dimensions."""
    of = F.col(f"`{vector}`")
    good = F.coalesce(F.forall(of, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))), F.lit(False)) & (F.size(of) > 0)
    rows = vectors.where(good)
    sizes = rows.groupBy(F.size(of).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dims = sizes["d"] if sizes else 0
    x = F.transform(of, lambda c: F.floor(c.cast("double") * 64).cast("long") + 1_000_000)
    return rows.where(F.size(of) == dims).select(F.struct("*").alias("_row"), x.alias("x")), dims


def _covariance(list_: DataFrame, values: list[Column], n: int) -> np.ndarray:
    """Sums of the products of all pairs of the (centred) columns, over n."""
    k = len(values)
    centred = list_.select(*(v.alias(f"c{i}") for i, v in enumerate(values)))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    out = np.zeros((k, k))
    for low in range(0, len(pairs), PAIRS_AT_ONCE):
        some = pairs[low : low + PAIRS_AT_ONCE]
        (sums,) = centred.selectExpr(*(f"sum(c{i} * c{j}) AS s{i}_{j}" for i, j in some)).collect()
        for (i, j), s in zip(some, sums, strict=True):
            out[i, j] = out[j, i] = s / n
    return out


def _deviations(model: Whitening) -> Column:
    """n * x - S of each dimension, whole numbers."""
    return F.zip_with("x", _array(model.sums), lambda x, s: x * model.n - s)


def _array(values: list) -> Column:
    return F.array(*map(F.lit, values))


def _projected(model: Whitening, y: Column, i: int) -> Column:
    """The whitened value of component i (from 0), from the deviations. As a function over arrays it stays small in plans and code, however many dimensions there are."""
    weights = model.components[i] / np.sqrt(model.values[i]) / model.n
    return F.aggregate(F.zip_with(y, _array(weights.tolist()), lambda d, w: d.cast("double") * w), F.lit(0.0), lambda a, b: a + b)


def fit(x: DataFrame, dims: int, most: int = 16) -> Whitening | None:
    """Fits column x, arrays of dims whole numbers; None if there is no row. identity_error is measured on the first ``most`` components."""
    if not dims:
        return None
    once = cut(x.groupBy("x").agg(F.lit(None).cast("int").alias("_")).select("x"))
    n, by_dim = once.count(), once.select(F.posexplode("x")).groupBy("pos").agg(F.sum("col").alias("s"), (F.max("col") - F.min("col")).alias("r")).orderBy("pos").collect()
    model = Whitening(n, [r["s"] for r in by_dim], max(r["r"] for r in by_dim), np.zeros(dims), np.eye(dims), 0.0)
    # Never null, which keeps the code small that Spark makes of the many sums.
    centred = [F.expr(f"coalesce(CAST(x[{i}] * {n}L - {total}L AS DOUBLE), 0D) * {1 / n!r}D") for i, total in enumerate(model.sums)]
    covariance = _covariance(once, centred, n)
    values, vectors = np.linalg.eigh(covariance)
    model.values, model.components, model.trace = values[::-1], vectors.T[::-1], float(np.trace(covariance))
    alive = [i for i in range(min(most, dims)) if model.alive(i)]
    if alive:
        whitened = once.select(_deviations(model).alias("y")).select(*(_projected(model, F.col("y"), i).alias(f"w{i}") for i in alive))
        (means,) = whitened.select(*(F.avg(f"w{i}") for i in alive)).collect()
        found = _covariance(whitened, [F.col(f"w{i}") - F.lit(m) for i, m in zip(alive, means, strict=True)], n)
        model.identity_error = float(np.abs(found - np.eye(len(alive))).max())
    return model


def whitened(vectors: DataFrame, kept: list[str], most: int = 16, vector: str = "embedding") -> DataFrame:
    """One row for each vector that takes part and each of the first ``most`` components: the kept columns, component, n, deviation, whitened, explained, identity_error.

    deviation is the exact sum over dimensions of (n * x - S) ** 2; where that may pass the range of a long it is computed
    in decimals, and a value beyond it is an error, not a wrong number.
    """
    rows, dims = gridded(vectors, vector)
    model = fit(rows.select("x"), dims, most)
    if model is None:
        taken = rows.where("false").select("_row", *(F.lit(None).cast(t).alias(c) for c, t in (("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))))
    else:
        small = model.dims * (model.n * model.spread) ** 2 < 1 << 63
        exact = "long" if small else "decimal(19)"
        squares = F.aggregate("y", F.lit(0).cast("long" if small else "decimal(38)"), lambda a, y: (a + y.cast(exact) * y.cast(exact)).cast("long" if small else "decimal(38)"))
        of = rows.select("_row", _deviations(model).alias("y")).select("_row", squares.cast("long").alias("deviation"), "y")
        explained = [F.lit(float(v / model.trace)) if model.trace > 0 else F.lit(None).cast("double") for v in model.values]
        parts = [F.struct(F.lit(i + 1).alias("component"), (_projected(model, F.col("y"), i) if model.alive(i) else F.lit(None).cast("double")).alias("whitened"), explained[i].alias("explained")) for i in range(min(most, dims))]
        taken = of.select("_row", "deviation", F.explode(F.array(*parts)).alias("_p")).select(
            "_row", "_p.component", F.lit(model.n).cast("long").alias("n"), "deviation", "_p.whitened", "_p.explained", F.lit(model.identity_error).cast("double").alias("identity_error"))
    return taken.select(*(F.col(f"_row.`{c}`") for c in kept), "component", "n", "deviation", "whitened", "explained", "identity_error")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), ["vec_id"])
