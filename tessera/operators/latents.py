"""Sparse activations: statistics, rankings, edges and chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sampling import per_group

EPSILON = 1e-6


def exploded(codes: DataFrame, keys: Sequence[str], ids: str, values: str) -> DataFrame:
    """Rows (keys, latent, value) of the non-zero components of sparse vectors."""
    return codes.select(*keys, F.explode(F.arrays_zip(ids, values)).alias("_p")).select(*keys, F.col(f"_p.{ids}").alias("latent"), F.col(f"_p.{values}").alias("value")).where("value <> 0")


def source_statistics(long: DataFrame, totals: DataFrame, human: str, ubiquitous: float = 0.5) -> DataFrame:
    """Long: rows (source, doc, latent, value), one for each active token; totals: rows (source, tokens, docs), a short list. Mass, rates, log-odds, specificity and score of each latent."""
    side = F.when(F.col("source") == human, "human").otherwise("ai")
    by = long.withColumn("side", side).groupBy("latent", "side", "doc").agg(F.sum("value").alias("m"), F.count("*").alias("t"), F.max("value").alias("x"))
    of = lambda c, s: F.sum(F.when(F.col("side") == s, c).otherwise(0))
    wide = by.groupBy("latent").agg(*[of(F.col("m"), s).alias(f"{s}_mass") for s in ("ai", "human")], *[of(F.col("t"), s).alias(f"{s}_active_tokens") for s in ("ai", "human")], *[of(F.lit(1), s).alias(f"{s}_active_docs") for s in ("ai", "human")], F.max("x").alias("max_activation"))
    sums = totals.withColumn("side", side).agg(*[of(F.col(c), s).alias(f"{s}_{c}") for s in ("ai", "human") for c in ("tokens", "docs")])
    c = F.col
    out = wide.crossJoin(F.broadcast(sums))  # one row
    out = out.withColumn("total_mass", c("ai_mass") + c("human_mass"))
    mass_rate = lambda s: c(f"{s}_mass") / F.greatest(F.lit(EPSILON), c(f"{s}_tokens").cast("double"))
    out = out.withColumn("log_odds", F.log((mass_rate("ai") + EPSILON) / (mass_rate("human") + EPSILON)))
    out = out.withColumn("active_token_rate", (c("ai_active_tokens") + c("human_active_tokens")) / F.greatest(F.lit(1), c("ai_tokens") + c("human_tokens")))
    for s in ("ai", "human"):
        out = out.withColumn(f"{s}_active_doc_rate", c(f"{s}_active_docs") / F.greatest(F.lit(1), c(f"{s}_docs")))
    out = out.withColumn("specificity", F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), c("active_token_rate") / F.lit(ubiquitous))))
    out = out.withColumn("ai_mass_share", c("ai_mass") / F.greatest(F.lit(EPSILON), c("total_mass")))
    return out.withColumn("preliminary_score", c("log_odds") * c("specificity") * F.log1p(c("total_mass"))).drop("ai_tokens", "human_tokens", "ai_docs", "human_docs")


def category(active_token_rate: Column, effect: Column, log_odds: Column) -> Column:
    """The first of five categories that fits."""
    return F.when(active_token_rate >= 0.95, "broad_or_ubiquitous").when(effect <= 0, "not_ai_score_positive").when(log_odds >= 2.0, "high_ai_enrichment").when(log_odds >= 1.0, "moderate_ai_enrichment").otherwise("weak_ai_enrichment")


def ranked_candidates(stats: DataFrame, effect: str, n: int) -> DataFrame:
    """Latents with mass by the product of positive log-odds, rarity, positive effect and log mass."""
    zero = F.lit(0.0)
    score = F.greatest(zero, F.col("log_odds")) * F.greatest(zero, 1.0 - F.col("active_token_rate")) * F.greatest(zero, F.col(effect)) * F.log1p(F.col("total_mass"))
    scored = stats.where("total_mass > 0").withColumn("score", score).withColumn("category", category(F.col("active_token_rate"), F.col(effect), F.col("log_odds")))
    order = [F.desc("score"), F.desc(effect), F.desc("log_odds"), F.col("latent")]
    return scored.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def document_maxima(long: DataFrame, token: str = "token") -> DataFrame:
    """The largest value of each latent in each document and its first token."""
    return long.groupBy("latent", "doc").agg(F.max("value").alias("max_value"), F.max_by(token, F.struct("value", -F.col(token))).alias("peak_token"))


def document_summary(long: DataFrame, n: int = 200) -> DataFrame:
    """Mass, tokens, maximum and peak of each latent in each document, the first n of a document."""
    out = long.groupBy("doc", "latent").agg(F.sum("value").alias("mass"), F.count("*").alias("tokens"), F.max("value").alias("max_value"), F.max_by("token", F.struct("value", -F.col("token"))).alias("peak_token"))
    return per_group(out, ["doc"], [F.desc("max_value"), F.desc("mass"), "latent"], n)


def token_summary(long: DataFrame, kind: str, top: int = 5) -> DataFrame:
    """For each document mass, maximum and number of active tokens, how many of each class (more first, then by name), and its top tokens by value."""
    by_class = long.groupBy("doc", kind).agg(F.count("*").alias("n"), F.sum("value").alias("mass"), F.max("value").alias("max_value"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(kind).alias("k")))), lambda x: F.concat(x["k"], F.lit(":"), (-x["m"]).cast("string")))
    sums = by_class.groupBy("doc").agg(F.sum("mass").alias("mass"), F.max("max_value").alias("max_value"), F.sum("n").alias("tokens"), F.array_join(ordered, ";").alias("classes"))
    best = per_group(long, ["doc"], [F.desc("value"), "token"], top).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("m"), "token"))).alias("t"))
    return sums.join(best, "doc").select("doc", "mass", "max_value", "tokens", "classes", F.array_join(F.transform("t", lambda x: x["token"].cast("string")), ";").alias("top_tokens"))


def examples(long: DataFrame, k: int) -> DataFrame:
    """The k largest documents of each latent, each document once."""
    return per_group(document_maxima(long), ["latent"], [F.desc("max_value"), "doc"], k)


def prompt_contrast(effects: DataFrame, human: str) -> DataFrame:
    """Mean effect on human less mean effect on other texts for each latent and prompt, with the document of the largest absolute effect."""
    e = F.col("effect")
    out = effects.groupBy("latent", "prompt").agg(F.avg(F.when(F.col("model") == human, e)).alias("human_mean"), F.avg(F.when(F.col("model") != human, e)).alias("ai_mean"), F.max_by("doc", F.struct(F.abs(e), F.col("doc"))).alias("representative"))
    return out.withColumn("contrast", F.col("human_mean") - F.col("ai_mean"))


def peak_profile(peaks: DataFrame, keys: Sequence[str], token: str, n: int = 8) -> DataFrame:
    """Shares of punctuation, periods and words among peak tokens, and the commonest tokens."""
    t = F.trim(token)
    shares = peaks.groupBy(*keys).agg(F.count("*").alias("peaks"), *[(F.count_if(c) / F.count("*")).alias(name) for name, c in (("period_share", t == "."), ("punctuation_share", t.rlike(r"^[^\p{L}\p{N}_\s]+$")), ("word_share", t.rlike(r"^[\p{L}\p{N}_]+$")))])
    counted = peaks.groupBy(*keys, t.alias("_t")).agg(F.count("*").alias("_n"))
    few = per_group(counted, keys, [F.desc("_n"), "_t"], n)  # limited before they are gathered
    tops = few.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("m"), "_t"))), lambda x: x["_t"]), " ").alias("top_tokens"))
    return shares.join(tops, [*keys])


def overlap_edges(nodes: DataFrame, adjacent: Sequence[tuple[int, int]], least_shared: int) -> DataFrame:
    """Nodes: rows (layer, latent, prompts array). Edges between adjacent layers with enough shared prompts, by an equi-join on prompts instead of all pairs, with Jaccard similarity."""
    hops = F.array(*[F.struct(F.lit(a).alias("l"), F.lit(b).alias("r")) for a, b in adjacent])
    one = nodes.withColumn("n", F.size("prompts")).select("layer", "latent", "n", F.explode("prompts").alias("prompt"))
    left = one.withColumn("_h", F.explode(F.filter(hops, lambda h: h["l"] == F.col("layer")))).select(F.col("layer").alias("left_layer"), F.col("latent").alias("left_latent"), F.col("n").alias("ln"), F.col("_h.r").alias("right_layer"), "prompt")
    right = one.select(F.col("layer").alias("right_layer"), F.col("latent").alias("right_latent"), F.col("n").alias("rn"), "prompt")
    out = left.join(right, ["right_layer", "prompt"]).groupBy("left_layer", "left_latent", "right_layer", "right_latent").agg(F.count("*").alias("shared"), F.first("ln").alias("ln"), F.first("rn").alias("rn"))
    return out.where(F.col("shared") >= least_shared).withColumn("jaccard", F.col("shared") / (F.col("ln") + F.col("rn") - F.col("shared"))).drop("ln", "rn")


def edge_score(shared: Column, jaccard: Column, cosine: Column, direction: Column) -> Column:
    """Q14."""
    return shared * (0.5 + jaccard) * F.greatest(F.lit(0.0), cosine) * (0.5 + 0.5 * F.greatest(F.lit(-1.0), F.least(F.lit(1.0), direction)))


def chains(edges: DataFrame, layers: Sequence[int], fan_out: int = 8, limit: int = 100) -> DataFrame:
    """Paths over the layers that follow the best edges of each node, by the geometric mean of their scores."""
    out = None
    for hop, (a, b) in enumerate(zip(layers, layers[1:], strict=False)):
        step = edges.where((F.col("left_layer") == a) & (F.col("right_layer") == b))
        if hop:
            step = per_group(edges, ["left_layer", "left_latent"], [F.desc("score"), "right_layer", "right_latent"], fan_out).where((F.col("left_layer") == a) & (F.col("right_layer") == b))
        step = step.select(F.col("left_latent").alias(f"n{hop}"), F.col("right_latent").alias(f"n{hop + 1}"), F.col("score").alias(f"s{hop}"))
        out = step if out is None else out.join(step, f"n{hop}")
    n = len(layers) - 1
    product = F.col("s0")
    for hop in range(1, n):
        product = product * F.col(f"s{hop}")
    nodes = [F.col(f"n{i}").cast("string") for i in range(n + 1)]
    return out.select(F.concat_ws(" -> ", *nodes).alias("chain"), F.pow(product, F.lit(1.0 / n)).alias("score")).orderBy(F.desc("score"), "chain").limit(limit)


def rises(df: DataFrame, within: Sequence[str], order: str, value: str) -> DataFrame:
    """The positive change from the token before."""
    return df.withColumn("rise", F.greatest(F.lit(0.0), F.col(value) - F.coalesce(F.lag(value).over(Window.partitionBy(*within).orderBy(order)), F.lit(0.0))))


def histogram(df: DataFrame, within: Sequence[str], value: str, bins: int = 16) -> DataFrame:
    """Equal bins up to each group's maximum, which falls into the last."""
    most = df.groupBy(*within).agg(F.max(value).alias("_max"))
    at = F.when(F.col("_max") > 0, F.least(F.lit(bins - 1), F.floor(F.col(value) / F.col("_max") * bins).cast("int"))).otherwise(0)
    return df.join(most, [*within]).groupBy(*within, at.alias("bin")).agg(F.count("*").alias("n"))


def controls(targets: DataFrame, candidates: DataFrame, within: Sequence[str], k: int, width: int = 50) -> DataFrame:
    """For each target the k candidates least by rank distance plus 25 for each shared prompt. Candidates within a width of ranks are met by buckets."""
    t = targets.select(*within, F.col("latent").alias("target"), F.col("rank").alias("_tr"), F.col("prompts").alias("_tp")).withColumn("_b", F.floor(F.col("_tr") / width))
    c = candidates.withColumn("_b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("rank") / width) + d)))
    met = t.join(c, [*within, "_b"]).where("latent <> target")
    cost = F.abs(F.col("rank") - F.col("_tr")) + 25 * F.size(F.array_intersect("prompts", "_tp"))
    return per_group(met.withColumn("cost", cost), [*within, "target"], ["cost", "latent"], k).select(*within, "target", "latent", "cost")


def token_context(tokens: Column, values: Column, k: int) -> Column:
    """The tokens around the peak with their values (missing ones 0)."""
    v = F.transform(values, lambda x: F.coalesce(x, F.lit(0.0)))
    at = F.array_position(v, F.array_max(v))
    low = F.greatest(F.lit(1).cast("long"), at - k).cast("int")
    return F.slice(F.arrays_zip(tokens.alias("token"), v.alias("value")), low, (F.least(F.size(tokens).cast("long"), at + k) - low + 1).cast("int"))


def peak_window(text: Column, start: Column, end: Column, around: int) -> Column:
    """The text around a peak, the peak in double brackets. Offsets count code points from 0."""
    low = F.greatest(F.lit(0), start - around)
    return F.concat(F.substring(text, low + 1, start - low), F.lit("[["), F.substring(text, start + 1, end - start), F.lit("]]"), F.substring(text, end + 1, F.lit(around)))


def enrichment(long: DataFrame, totals: DataFrame, human: str, n: int) -> DataFrame:
    """Latents with mass by log-odds of mass rates, then share, then mass. Unlike A24 a side counts at least one token."""
    side = lambda c, yes: F.sum(F.when((F.col("source") == human) == yes, c).otherwise(0.0))
    mass = long.groupBy("latent", "source").agg(F.sum("value").alias("m"), F.max("value").alias("x"))
    wide = mass.groupBy("latent").agg(side(F.col("m"), False).alias("ai_mass"), side(F.col("m"), True).alias("human_mass"), F.max("x").alias("max_activation"))
    sums = totals.agg(side(F.col("tokens").cast("double"), False).alias("_a"), side(F.col("tokens").cast("double"), True).alias("_h"))
    out = wide.crossJoin(F.broadcast(sums)).withColumn("total_mass", F.col("ai_mass") + F.col("human_mass")).where("total_mass > 0")  # one row
    per = lambda m, t: F.col(m) / F.greatest(F.lit(1.0), F.col(t)) + EPSILON
    out = out.withColumn("log_odds", F.log(per("ai_mass", "_a") / per("human_mass", "_h"))).withColumn("ai_mass_share", F.col("ai_mass") / F.greatest(F.lit(EPSILON), F.col("total_mass"))).drop("_a", "_h")
    order = [F.desc("log_odds"), F.desc("ai_mass_share"), F.desc("total_mass"), F.col("latent")]
    return out.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def control_panel(panel: DataFrame, k: int) -> DataFrame:
    """For each target the anchor rows (upstream alone, downstream alone, both) and, for its first k controls of either kind, the control alone and with the anchor's other end."""
    t = F.col("target")
    row = lambda label, kind, *nodes: F.struct(label.alias("label"), kind.alias("control_type"), F.concat_ws("+", *nodes).alias("nodes"))
    up, down, anchor = F.col("chain_upstream"), F.col("chain_downstream"), F.lit("anchor")
    anchors = panel.select("target", "chain_upstream", "chain_downstream").distinct().select(t, F.inline(F.array(row(F.lit("anchor_upstream_only"), anchor, up), row(F.lit("anchor_downstream_only"), anchor, down), row(F.lit("anchor_joint"), anchor, up, down))))
    first = panel.withColumn("i", F.row_number().over(Window.partitionBy("target", "control_type").orderBy("position"))).where(F.col("i") <= k)
    upstream = F.col("control_type") == "different_upstream_same_downstream"
    own = F.when(upstream, F.col("upstream")).otherwise(F.col("downstream"))
    name = F.when(upstream, "upstream").otherwise("downstream")
    alone = row(F.concat(F.lit("control_"), name, F.lit("_only_"), F.col("i").cast("string")), F.col("control_type"), own)
    both = F.when(upstream, row(F.concat(F.lit("control_upstream_plus_anchor_downstream_"), F.col("i").cast("string")), F.col("control_type"), own, down)).otherwise(row(F.concat(F.lit("anchor_upstream_plus_control_downstream_"), F.col("i").cast("string")), F.col("control_type"), up, own))
    return anchors.unionByName(first.select(t, F.inline(F.array(alone, both))))
