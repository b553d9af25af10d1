"""Feature rates and paired comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import rate, safe_rate, safe_ratio
from .sampling import per_group


def _unpivot(df: DataFrame, keys: Sequence[str], values: Mapping[str, str], name: str = "feature") -> DataFrame:
    pairs = ", ".join(f"'{label}', `{column}`" for label, column in values.items())
    return df.selectExpr(*[f"`{k}`" for k in keys], f"stack({len(values)}, {pairs}) AS ({name}, value)")


def census(df: DataFrame, keys: Sequence[str], tokens: Column, features: Mapping[str, Column]) -> DataFrame:
    """A1: count, docs, tokens, per_1k_tokens and per_doc of each feature for each group.

    Features stay columns through the partial aggregation; only the small result becomes long.
    """
    named = {f: f"_f{i}" for i, f in enumerate(features)}
    wide = df.select(*keys, tokens.cast("long").alias("_tokens"), *[features[f].cast("double").alias(c) for f, c in named.items()])
    sums = wide.groupBy(*keys).agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("docs"), *[F.sum(c).alias(c) for c in named.values()])
    long = _unpivot(sums, [*keys, "docs", "tokens"], named)
    return with_rates(long.withColumnRenamed("value", "count"))


def with_rates(df: DataFrame) -> DataFrame:
    return df.withColumn("per_1k_tokens", rate(F.col("count"), F.col("tokens"))).withColumn("per_doc", rate(F.col("count"), F.col("docs"), 1.0))


def regroup(rates: DataFrame, corpus: Sequence[str], stratum: str) -> DataFrame:
    """A2: sums again by corpus and by stratum in one pass (grouping sets); null strata stay apart from the total by level."""
    keys = [*corpus, "feature"]
    sets = rates.groupingSets([[*map(F.col, keys)], [*map(F.col, keys), F.col(stratum)]], *keys, stratum)
    out = sets.agg(F.grouping(stratum).alias("g"), F.sum("count").alias("count"), F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    return with_rates(out.withColumn("level", F.when(F.col("g") == 1, "corpus").otherwise("stratum")).drop("g"))


def pair_deltas(sides: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A3: sides: rows (keys, feature, role chosen or rejected, count, tokens). One row for each pair and feature with both rates and their difference."""
    out = sides.groupBy(*keys, "feature").agg(*[F.sum(F.when(F.col("role") == r, F.col(c))).alias(f"{r}_{c}") for r in ("chosen", "rejected") for c in ("count", "tokens")])
    for r in ("chosen", "rejected"):
        out = out.withColumn(f"{r}_count", F.coalesce(f"{r}_count", F.lit(0.0))).withColumn(f"{r}_tokens", F.coalesce(f"{r}_tokens", F.lit(0).cast("long")))
        out = out.withColumn(f"{r}_rate_per_1k_tokens", rate(F.col(f"{r}_count"), F.col(f"{r}_tokens")))
    return out.withColumn("chosen_minus_rejected", F.col("chosen_rate_per_1k_tokens") - F.col("rejected_rate_per_1k_tokens"))


def paired_summary(deltas: DataFrame, keys: Sequence[str], delta: str = "chosen_minus_rejected") -> DataFrame:
    """A4: signs, mean, median and direction of paired differences."""
    d = F.col(delta)
    out = deltas.groupBy(*keys).agg(F.count("*").alias("pairs"), F.count_if(d > 0).alias("positive"), F.count_if(d < 0).alias("negative"), F.count_if(d == 0).alias("zero"), F.avg(d).alias("mean_delta"), F.median(d).alias("median_delta"))
    way = F.when(F.col("positive") > F.col("negative"), "chosen_gt_rejected").when(F.col("positive") < F.col("negative"), "rejected_gt_chosen").otherwise("tie")
    return out.withColumn("direction", way)


def denominator_support(opportunities: DataFrame, keys: Sequence[str], record: str) -> DataFrame:
    """A5: records, opportunities, initiations, their rate, and a histogram of subtypes as JSON."""
    starts = F.col("initiates").cast("int")
    base = opportunities.groupBy(*keys).agg(F.count_distinct(record).alias("docs_with_opportunity"), F.count_distinct(F.when(F.col("initiates"), F.col(record))).alias("docs_with_reference"), F.count("*").alias("opportunities"), F.sum(starts).alias("initiations"))
    by_subtype = opportunities.where("initiates").groupBy(*keys, "subtype").agg(F.count("*").alias("n"))
    histogram = by_subtype.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("subtype", "n"))))).alias("subtypes"))
    out = base.join(histogram, [*keys], "left").withColumn("subtypes", F.coalesce("subtypes", F.lit("{}")))
    return out.withColumn("reference_rate", safe_rate(F.col("initiations"), F.col("opportunities")))


def amplification(scores: DataFrame, keys: Sequence[str], baseline: str, weight: str | None = None) -> DataFrame:
    """Reference rate, mean probability mass, their quotient (0 if undefined), and that over the baseline feature's. A row stands for as many opportunities of equal mass as its weight says, and initiates is their sum."""
    n = F.sum(weight) if weight else F.count("*")
    mass = F.sum(F.col("prob_mass") * F.col(weight)) if weight else F.sum("prob_mass")
    sums = scores.groupBy(*keys, "feature").agg(n.alias("opportunities"), F.sum("initiates").alias("reference_initiations"), mass.alias("mass"))
    out = sums.withColumn("reference_rate", safe_rate(F.col("reference_initiations"), F.col("opportunities"))).withColumn("mean_prob_mass", safe_rate(F.col("mass"), F.col("opportunities"))).drop("mass")
    out = out.withColumn("amplification_factor", safe_rate(F.col("mean_prob_mass"), F.col("reference_rate")))
    base = out.where(F.col("feature") == baseline).select(*keys, F.col("amplification_factor").alias("_base"))
    joined = out.join(base, [*keys], "left") if keys else out.crossJoin(F.broadcast(base))  # without keys the baseline is one row
    return joined.withColumn("normalized_amplification_factor", safe_rate(F.col("amplification_factor"), F.coalesce("_base", F.lit(0.0)))).drop("_base")


def emission(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts: one row (keys, count, tokens) for each generation and feature."""
    c = F.col("count")
    out = counts.groupBy(*keys).agg(F.count("*").alias("generations"), F.sum("tokens").alias("tokens"), F.sum(c).alias("feature_count"), F.sum(F.greatest(F.lit(0).cast("long"), c - 1)).alias("repeated_count"), F.count_if(c > 0).alias("generations_with_feature"), F.count_if(c > 1).alias("repeat_generations"))
    return (
        out.withColumn("per_1k_tokens", rate(F.col("feature_count"), F.col("tokens")))
        .withColumn("repeated_per_1k_tokens", rate(F.col("repeated_count"), F.col("tokens")))
        .withColumn("per_generation", safe_rate(F.col("feature_count"), F.col("generations")))
        .withColumn("share_with_feature", safe_rate(F.col("generations_with_feature"), F.col("generations")))
        .withColumn("share_repeating", safe_rate(F.col("repeat_generations"), F.col("generations")))
        .withColumn("repeat_share_of_hits", safe_rate(F.col("repeated_count"), F.col("feature_count")))
    )


WINDOW_SUMS = ("windows", "prior_windows", "no_prior_windows", "hit_windows_after_prior", "hit_windows_without_prior")


def window_counters(windows: DataFrame, keys: Sequence[str], generation: str, order: str) -> DataFrame:
    """Windows: rows (keys, generation, order, hits). Counters of hit windows with and without an earlier hit in the generation."""
    from pyspark.sql.window import Window

    before = Window.partitionBy(*keys, generation).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    flagged = windows.withColumn("_prior", F.coalesce(F.max(F.col("hits") > 0).over(before), F.lit(False))).withColumn("_hit", F.col("hits") > 0)
    return flagged.groupBy(*keys).agg(
        F.count("*").alias("windows"),
        F.count_if("_prior").alias("prior_windows"),
        F.count_if(~F.col("_prior")).alias("no_prior_windows"),
        F.count_if(F.col("_prior") & F.col("_hit")).alias("hit_windows_after_prior"),
        F.count_if(~F.col("_prior") & F.col("_hit")).alias("hit_windows_without_prior"),
    )


def compounding(counters: DataFrame) -> DataFrame:
    """Q13: hit rates after and without an earlier hit, their difference and quotient."""
    a = safe_rate(F.col("hit_windows_after_prior"), F.col("prior_windows"))
    b = safe_rate(F.col("hit_windows_without_prior"), F.col("no_prior_windows"))
    return counters.withColumn("rate_after_prior", a).withColumn("rate_without_prior", b).withColumn("risk_difference", a - b).withColumn("risk_ratio", safe_ratio(a, b))


def pooled(rates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A10: pooled rate; the mean of the rates only where no tokens are known."""
    out = rates.groupBy(*keys).agg(F.sum("count").alias("count"), F.sum("tokens").alias("tokens"), F.avg("per_1k_tokens").alias("_mean"))
    return out.withColumn("pooled_per_1k", F.when(F.col("tokens") > 0, rate(F.col("count"), F.col("tokens"))).otherwise(F.col("_mean"))).drop("_mean")


def weighted_baseline(weights: DataFrame, rates: DataFrame) -> DataFrame:
    """Weights: rows (source, share, exact); rates: rows (source, feature, rate). For each feature covered, exact and missing share, mean over what is covered, sum with what is missing as zero, and the sources in order."""
    joined = weights.join(rates, "source")
    out = joined.groupBy("feature").agg(
        F.sum("share").alias("covered_share"),
        F.sum(F.when(F.col("exact"), F.col("share")).otherwise(0.0)).alias("exact_share"),
        F.sum(F.col("share") * F.col("rate")).alias("missing_as_zero"),
        F.array_join(F.array_sort(F.collect_set("source")), ";").alias("sources"),
    )
    return out.withColumn("missing_share", F.greatest(F.lit(0.0), 1.0 - F.col("covered_share"))).withColumn("covered_mean", safe_rate(F.col("missing_as_zero"), F.col("covered_share")))


def weighted_means(df: DataFrame, keys: Sequence[str], weight: str, values: Sequence[str]) -> DataFrame:
    """Token-weighted means, a weight of 1 at least."""
    w = F.greatest(F.col(weight).cast("double"), F.lit(1.0))
    wide = df.groupBy(*keys).agg(*[(F.sum(F.col(v) * w) / F.sum(w)).alias(v) for v in values])
    return _unpivot(wide, keys, {v: v for v in values})


def top_items(df: DataFrame, keys: Sequence[str], item: str, n: int, name: str = "top_items") -> DataFrame:
    """Group size, its commonest item (ties: the least) and the n commonest as text. Items are limited before they are gathered."""
    by_item = df.groupBy(*keys, item).agg(F.count("*").alias("_n"))
    sizes = by_item.groupBy(*keys).agg(F.sum("_n").alias("n"))
    few = per_group(by_item, keys, [F.desc("_n"), item], max(n, 1))
    best = few.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("m"), F.col(item).alias("v")))).alias("_best"))
    met = sizes.join(best, F.lit(True) if not keys else _null_safe(sizes, best, keys), "inner").select(*[sizes[k] for k in keys], "n", "_best")
    return met.select(*keys, "n", F.element_at("_best", 1)["v"].alias("top"), F.array_join(F.transform(F.slice("_best", 1, n), lambda x: x["v"]), ";").alias(name))


def _null_safe(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out
