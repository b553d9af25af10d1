"""Statistics: tests, corrections, ranks, fits, bootstraps, distances and classification."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import safe_ratio
from ..sources.records import dense_index
from ..storage import cut


def sign_test_p(positive: int, negative: int) -> float:
    """Two-sided binomial tail at one half, zeros dropped; 1 without trials."""
    n = positive + negative
    if not n:
        return 1.0
    logs = np.array([math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for k in range(min(positive, negative) + 1)]) - n * math.log(2)
    top = logs.max()
    return min(1.0, 2.0 * math.exp(top) * float(np.exp(logs - top).sum()))


def sign_test(positive: str = "positive", negative: str = "negative") -> Column:
    """Q1 over a table of group counts."""

    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([sign_test_p(int(x), int(y)) for x, y in zip(a, b, strict=True)], dtype=float)

    return p(F.col(positive).cast("long"), F.col(negative).cast("long"))


RUN = 100_000  # rows of an order in one task


def _suffix_min(df: DataFrame, value: Column, index: str, out: str) -> DataFrame:
    """The least value from each row on, over a gapless index: within runs of rows, and over what the later runs hold."""
    marked = df.withColumn("_v", value).withColumn("_run", F.floor(F.col(index) / RUN))
    within = F.min("_v").over(Window.partitionBy("_run").orderBy(F.desc(index)).rowsBetween(Window.unboundedPreceding, 0))
    later = F.min("_least").over(Window.orderBy(F.desc("_run")).rowsBetween(Window.unboundedPreceding, -1))
    runs = marked.groupBy("_run").agg(F.min("_v").alias("_least")).withColumn("_later", later).drop("_least")  # one row for each run
    return marked.withColumn(out, within).join(F.broadcast(runs), "_run").withColumn(out, F.least(out, "_later")).drop("_v", "_run", "_later")


def false_discovery(df: DataFrame, p: str = "p_value", out: str = "q_value", within: Sequence[str] = ()) -> DataFrame:
    """Benjamini-Hochberg, within groups or over all rows; the latter by a range sort, so no task holds all of them."""
    if not within:
        ranked = dense_index(df, [p])
        m = ranked.agg(F.count("*").alias("_m"))
        scaled = ranked.crossJoin(F.broadcast(m))  # one row
        found = _suffix_min(scaled, F.col(p) * F.col("_m") / (F.col("row_index") + 1), "row_index", out)
        return found.withColumn(out, F.least(out, F.lit(1.0))).drop("_m", "row_index")
    by = Window.partitionBy(*within)
    rank = F.row_number().over(by.orderBy(p))
    total = F.count("*").over(by)
    ranked = df.withColumn("_r", rank).withColumn("_m", total)
    least = F.min(F.col(p) * F.col("_m") / F.col("_r")).over(by.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn(out, F.least(least, F.lit(1.0))).drop("_r", "_m")


def with_average_rank(df: DataFrame, column: str, out: str, within: Sequence[str] = ()) -> DataFrame:
    """Adds the mean rank of ties, within groups or over all rows; the latter over counts of values by a range sort."""
    if within:
        order = Window.partitionBy(*within).orderBy(column)
        ties = F.count("*").over(Window.partitionBy(*within, column))
        return df.withColumn(out, F.rank().over(order) + (ties - 1) / F.lit(2.0))
    values = dense_index(df.groupBy(column).agg(F.count("*").alias("_n")), [column]).withColumn("_run", F.floor(F.col("row_index") / RUN))
    sums = values.groupBy("_run").agg(F.sum("_n").alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each run
    own = F.sum("_n").over(Window.partitionBy("_run").orderBy("row_index"))
    ranks = values.withColumn("_own", own).join(F.broadcast(sums.withColumn("_before", before).drop("_s")), "_run")
    ranked = ranks.select(F.col(column).alias("_value"), (F.col("_before") + F.col("_own") - (F.col("_n") - 1) / F.lit(2.0)).alias(out))
    return df.join(ranked, F.col(column).eqNullSafe(F.col("_value"))).drop("_value")


def spearman(df: DataFrame, a: str, b: str, within: Sequence[str] = ()) -> DataFrame:
    """Q9: rank correlation; null for fewer than two rows or no variance."""
    ranked = with_average_rank(with_average_rank(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, "_a", within), b, "_b", within)
    out = ranked.groupBy(*within).agg(F.count("*").alias("n"), F.covar_pop("_a", "_b").alias("_c"), (F.stddev_pop("_a") * F.stddev_pop("_b")).alias("_s"))
    return out.withColumn("spearman", F.when(F.col("n") > 1, F.col("_c") / F.nullif(F.col("_s"), F.lit(0.0)))).drop("_c", "_s")


LOGIT = "logit_feature_coef double, logit_feature_se double, logit_feature_z double, logit_feature_odds_ratio double, logit_length_coef double, logit_iterations int, logit_converged boolean"


def length_adjusted_logit(feature: np.ndarray, length: np.ndarray, y: np.ndarray, ridge: float = 0.1, most: int = 50, tolerance: float = 1e-7) -> tuple:
    """Q3: Newton's method for a logistic model of standardized feature and length, both slopes with a ridge penalty."""

    def standard(x):
        scale = x.std()
        return (x - x.mean()) / scale if scale > 1e-12 else np.zeros_like(x)

    x = np.column_stack([np.ones(len(y)), standard(feature), standard(length)])
    penalty, beta, done, n = np.diag([0.0, ridge, ridge]), np.zeros(3), False, 0

    def chance():
        return 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -700, 700)))

    def information(p):
        return (x * (p * (1 - p))[:, None]).T @ x + penalty

    while n < most and not done:
        p = chance()
        try:
            step = np.linalg.solve(information(p), x.T @ (y - p) - penalty @ beta)
        except np.linalg.LinAlgError:
            break
        beta, n = beta + step, n + 1
        done = bool(np.abs(step).max() < tolerance)
    try:
        error = math.sqrt(max(np.linalg.inv(information(chance()))[1, 1], 0.0))
    except np.linalg.LinAlgError:
        error = 0.0
    return float(beta[1]), error, float(beta[1]) / error if error else 0.0, math.exp(min(max(float(beta[1]), -50.0), 50.0)), float(beta[2]), n, done


def _newton(pdf: pd.DataFrame, ridge: float, tolerance: float) -> pd.DataFrame:
    """One step for each row: sums of gradient and information of a group, its coefficients and state."""
    out = []
    for r in pdf.itertuples():
        beta, done, n, converged = np.array(r.beta), r.done, r.n, r.converged
        if not done:
            penalty = np.diag([0.0, ridge, ridge])
            info = np.array(r.info).reshape(3, 3) + penalty
            try:
                step = np.linalg.solve(info, np.array(r.gradient) - penalty @ beta)
                beta, n = beta + step, n + 1
                converged = bool(np.abs(step).max() < tolerance)
                done = converged
            except np.linalg.LinAlgError:
                done = True
        out.append((beta.tolist(), done, n, converged))
    return pdf.drop(columns=["gradient", "info", "beta", "done", "n", "converged"]).assign(**{c: [o[i] for o in out] for i, c in enumerate(("beta", "done", "n", "converged"))})


def logit_by_group(deltas: DataFrame, keys: Sequence[str], ridge: float = 0.1, most: int = 50, tolerance: float = 1e-7) -> DataFrame:
    """Q3 for each group of pair deltas: chosen against rejected.

    Newton's method on sums: each step is one aggregation over all pairs, partial before the shuffle, and a 3 by 3
    system for each group, so no group is in one task.
    """
    one = lambda side, y: F.struct(F.col(f"{side}_rate_per_1k_tokens").cast("double").alias("x"), F.col(f"{side}_tokens").cast("double").alias("l"), F.lit(y).alias("y"))
    rows = cut(deltas.select(*keys, F.inline(F.array(one("chosen", 1.0), one("rejected", 0.0)))))
    scale = lambda c: F.when(F.stddev_pop(c) > 1e-12, F.stddev_pop(c))
    moments = rows.groupBy(*keys).agg(F.avg("x").alias("xm"), scale("x").alias("xs"), F.avg("l").alias("lm"), scale("l").alias("ls"))
    zero = F.array(*[F.lit(0.0)] * 3)
    state = cut(moments.withColumns({"beta": zero, "done": F.lit(False), "n": F.lit(0), "converged": F.lit(False)}))

    def sums(state: DataFrame) -> DataFrame:
        met = rows.join(state, [*keys])
        v = [F.lit(1.0), F.coalesce((F.col("x") - F.col("xm")) / F.col("xs"), F.lit(0.0)), F.coalesce((F.col("l") - F.col("lm")) / F.col("ls"), F.lit(0.0))]
        eta = sum((v[i] * F.col("beta")[i] for i in range(1, 3)), F.col("beta")[0])
        p = 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), eta))))
        weighed = met.select(*keys, *[c.alias(f"v{i}") for i, c in enumerate(v)], (F.col("y") - p).alias("e"), (p * (1 - p)).alias("w"))
        g = [F.sum(F.col(f"v{i}") * F.col("e")).alias(f"g{i}") for i in range(3)]
        h = [F.sum(F.col(f"v{i}") * F.col(f"v{j}") * F.col("w")).alias(f"h{i}{j}") for i in range(3) for j in range(i, 3)]
        added = weighed.groupBy(*keys).agg(*g, *h)
        info = F.array(*[F.col(f"h{min(i, j)}{max(i, j)}") for i in range(3) for j in range(3)])
        return state.join(added.select(*keys, F.array("g0", "g1", "g2").alias("gradient"), info.alias("info")), [*keys])

    for _ in range(most):
        if state.where(~F.col("done")).isEmpty():
            break
        state = cut(sums(state).mapInPandas(lambda pdfs: (_newton(pdf, ridge, tolerance) for pdf in pdfs), state.schema))
    final = sums(state)

    def finish(pdfs):
        for pdf in pdfs:
            out = []
            for r in pdf.itertuples():
                try:
                    error = math.sqrt(max(np.linalg.inv(np.array(r.info).reshape(3, 3) + np.diag([0.0, ridge, ridge]))[1, 1], 0.0))
                except np.linalg.LinAlgError:
                    error = 0.0
                b = float(r.beta[1])
                out.append((b, error, b / error if error else 0.0, math.exp(min(max(b, -50.0), 50.0)), float(r.beta[2]), int(r.n), bool(r.converged)))
            yield pd.concat([pdf[list(keys)].reset_index(drop=True), pd.DataFrame(out, columns=[x.split()[0] for x in LOGIT.split(", ")])], axis=1)

    kinds = ", ".join(f"{k} {deltas.schema[k].dataType.simpleString()}" for k in keys)
    return final.mapInPandas(finish, f"{kinds}, {LOGIT}")


#: Cumulative chances of 0, 1, 2, ... under a Poisson law of mean 1.
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(9)]


def resampled(clusters: DataFrame, keys: Sequence[str], cluster: str, sums: Sequence[str], replicates: int = 200, seed: int = 13) -> DataFrame:
    """Q4 to Q8: sums of each bootstrap replicate of the clusters of each cell: rows (keys, replicate, sums).

    A cluster's weight in a replicate is a Poisson draw of mean 1 from a hash, so replicates need no shuffle of
    clusters and features of a document share their draw (Q5). Sums are partial before the shuffle.
    """
    u = F.shiftrightunsigned(F.xxhash64(F.col(cluster).cast("string"), F.col("replicate"), F.lit(seed)), 11) / F.lit(float(1 << 53))
    weight = F.lit(0)
    for chance in POISSON:
        weight = weight + (u >= chance).cast("int")
    drawn = clusters.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("_w", weight)
    return drawn.groupBy(*keys, "replicate").agg(*[F.sum(F.col(s) * F.col("_w")).alias(s) for s in sums])


def intervals(replicates: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """The middle 95 % of finite values of each metric, by linear interpolation."""
    out = []
    for m in metrics:
        finite = F.when(~F.isnan(m) & (F.abs(m) < float("inf")), F.col(m))
        out += [F.percentile(finite, F.lit(0.025)).alias(f"{m}_low"), F.percentile(finite, F.lit(0.975)).alias(f"{m}_high")]
    return replicates.groupBy(*keys).agg(*out)


def distances(long: DataFrame, name: str, key: Sequence[str], value: str) -> DataFrame:
    """Q10: euclidean and cosine distance of each two named vectors on the keys that both have."""
    known = long.where(F.col(value).isNotNull())
    a = known.select(F.col(name).alias("a"), *key, F.col(value).alias("x"))
    b = known.select(F.col(name).alias("b"), *key, F.col(value).alias("y"))
    met = a.join(b, [*key]).where("a < b")
    out = met.groupBy("a", "b").agg(F.count("*").alias("shared"), F.sqrt(F.sum((F.col("x") - F.col("y")) ** 2)).alias("euclidean"), F.sum(F.col("x") * F.col("y")).alias("_xy"), F.sqrt(F.sum(F.col("x") ** 2)).alias("_x"), F.sqrt(F.sum(F.col("y") ** 2)).alias("_y"))
    return out.withColumn("cosine", F.when((F.col("_x") > 0) & (F.col("_y") > 0), 1.0 - F.col("_xy") / (F.col("_x") * F.col("_y")))).drop("_xy", "_x", "_y")


def kappa(df: DataFrame, a: str, b: str, within: Sequence[str] = ()) -> DataFrame:
    """Q11: Cohen's kappa; if chance agreement is complete, 1 for agreement and 0 otherwise."""
    cells = df.groupBy(*within, a, b).agg(F.count("*").alias("_n"))
    side = {c: cells.groupBy(*within, F.col(c).alias("_v")).agg(F.sum("_n").alias(f"_{c}")) for c in (a, b)}
    both = side[a].join(side[b], [*within, "_v"]).groupBy(*within).agg(F.sum(F.col(f"_{a}") * F.col(f"_{b}")).alias("_chance"))
    seen = cells.groupBy(*within).agg(F.sum("_n").alias("n"), F.sum(F.when(F.col(a).eqNullSafe(F.col(b)), F.col("_n")).otherwise(0)).alias("agreed"))
    out = seen.join(both, [*within], "left") if within else seen.crossJoin(F.broadcast(both))  # one row each
    observed, expected = F.col("agreed") / F.col("n"), F.coalesce(F.col("_chance"), F.lit(0)) / (F.col("n") * F.col("n"))
    k = F.when(expected == 1, (observed == 1).cast("double")).otherwise((observed - expected) / F.nullif(1 - expected, F.lit(0.0)))
    return out.select(*within, "n", "agreed", observed.alias("agreement"), k.alias("kappa"))


def stage_references(df: DataFrame, keys: Sequence[str], stages: Sequence[str], stage: str = "stage", value: str = "value") -> DataFrame:
    """Each row with the same metric's value at every stage, and its difference and ratio to the first."""
    w = Window.partitionBy(*keys)
    out = df
    for s in stages:
        out = out.withColumn(f"{s}_value", F.max(F.when(F.col(stage) == s, F.col(value))).over(w))
    first = f"{stages[0]}_value"
    return out.withColumn("delta_first", F.col(value) - F.col(first)).withColumn("ratio_first", safe_ratio(F.col(value), F.col(first)))


def against_first_and_previous(df: DataFrame, within: Sequence[str], order: str, value: str) -> DataFrame:
    """Difference and ratio to the first and to the previous stage."""
    w = Window.partitionBy(*within).orderBy(order)
    first, before = F.first(value).over(w), F.lag(value).over(w)
    v = F.col(value)
    return df.withColumn("delta_first", v - first).withColumn("ratio_first", safe_ratio(v, first)).withColumn("delta_previous", v - before).withColumn("ratio_previous", safe_ratio(v, before))
