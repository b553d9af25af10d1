"""Human labels: precision, regions, agreement, adjudication and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_rate
from .joins import asserted
from .stats import kappa


def precision(labels: DataFrame, core: Sequence[str] = (), derived: Sequence[str] = (), target: float = 0.9, most_ambiguous: float = 0.1, least: int = 50) -> DataFrame:
    """Counts of each label, precision, gates and status by feature."""
    c = F.col
    out = labels.groupBy(F.coalesce("feature", F.lit("unknown")).alias("feature")).agg(F.count("*").alias("labeled"), *[F.count_if(c("label") == x).alias(x) for x in ("exact", "partial", "false_positive", "ambiguous")])
    out = out.withColumn("precision", safe_rate(c("exact"), c("labeled"))).withColumn("ambiguous_rate", safe_rate(c("ambiguous"), c("labeled")))
    out = out.withColumn("precision_pass", c("precision") >= target).withColumn("ambiguity_pass", c("ambiguous_rate") <= most_ambiguous)
    out = out.withColumn("sample_size_pass", (c("labeled") >= least) | ~c("feature").isin(*core) if core else F.lit(True))
    status = F.when(c("feature").isin(*derived) if derived else F.lit(False), "derived").when(c("precision_pass") & c("ambiguity_pass") & c("sample_size_pass"), "pass").otherwise("demote")
    return out.withColumn("status", status)


def regions(labels: DataFrame) -> DataFrame:
    """Perception counts, the modal taxonomy label (ties: the larger text) and the region by feature."""
    c = F.col
    base = labels.groupBy("feature").agg(F.count("*").alias("total"), *[F.count_if(c("perception") == x).alias(x) for x in ("yes", "context_dependent", "no", "unclear")])
    by = labels.where("taxonomy <> ''").groupBy("feature", "taxonomy").agg(F.count("*").alias("n"))
    top = by.groupBy("feature").agg(F.max_by("taxonomy", F.struct("n", "taxonomy")).alias("top_taxonomy"))
    out = base.join(top, "feature", "left").withColumn("labeled", c("yes") + c("context_dependent") + c("no") + c("unclear"))
    share = lambda x: safe_rate(x, c("labeled"))
    region = (
        F.when(c("labeled") == 0, "unlabeled")
        .when((share(c("yes")) >= 0.5) | (share(c("yes") + c("context_dependent")) >= 0.65), "detector_and_human_perceived")
        .when((share(c("no")) >= 0.5) & (c("labeled") >= F.least(F.lit(20), c("total"))), "detector_only_or_domain_artifact")
        .otherwise("mixed_or_unresolved")
    )
    return out.withColumn("region", region).withColumn("top_taxonomy", F.coalesce("top_taxonomy", F.lit("")))


def met(a: DataFrame, b: DataFrame, key: str, label: str) -> DataFrame:
    """Both annotators' labels; a key that one side lacks is an error."""
    both = a.select(key, "feature", F.col(label).alias("a"), F.lit(1).alias("_a")).join(b.select(key, F.col(label).alias("b"), F.lit(1).alias("_b")), key, "full_outer")
    return asserted(both, F.col("_a").isNull() | F.col("_b").isNull(), "the annotators labelled different rows").drop("_a", "_b")


def agreement(pairs: DataFrame) -> DataFrame:
    """Rows, both labelled, agreement and yes-no conflicts by feature and in all (one pass over a rollup), with Cohen's kappa."""
    a, b = F.col("a"), F.col("b")
    both = (a != "") & (b != "")
    rolled = pairs.rollup("feature").agg(F.grouping("feature").alias("_g"), F.count("*").alias("rows_compared"), F.count_if(both).alias("both_labeled"), F.count_if(both & (a == b)).alias("agreed"), F.count_if((a.isin("yes") & b.isin("no")) | (a.isin("no") & b.isin("yes"))).alias("yes_no_conflicts"))
    rolled = rolled.withColumn("feature", F.when(F.col("_g") == 1, "ALL").otherwise(F.col("feature"))).drop("_g")
    labelled = pairs.where(both).select(F.explode(F.array("feature", F.lit("ALL"))).alias("feature"), "a", "b")
    k = kappa(labelled, "a", "b", ["feature"]).select("feature", "kappa")
    return rolled.join(k, "feature", "left").withColumn("agreement_rate", safe_rate(F.col("agreed"), F.col("both_labeled")))


def adjudicated(pairs: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """The common label, else the decision's; decisions on rows that are unknown or agreed are an error."""
    joined = pairs.join(decisions.select(key, F.col("label").alias("decision")), key, "full_outer")
    wrong = F.col("decision").isNotNull() & (F.col("a").isNull() | (F.col("a") == F.col("b")))
    out = asserted(joined, wrong, "a decision on a row that needs none")
    return out.withColumn("final", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("decision"))).withColumn("open", F.col("final").isNull())


def unblinded(blind: DataFrame, private: DataFrame, key: str, guarded: Sequence[str]) -> DataFrame:
    """Blind labels with their private rows; a missing row or a changed guarded field is an error."""
    renamed = private.select(key, *[F.col(c).alias(f"_p_{c}") for c in private.columns if c != key], F.lit(1).alias("_m"))
    joined = blind.join(renamed, key, "left")
    changed = F.lit(False)
    for c in guarded:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    out = asserted(joined, F.col("_m").isNull() | changed, "a blind row without its private row or with a changed field").drop("_m", *[f"_p_{c}" for c in guarded])
    return out.withColumnsRenamed({f"_p_{c}": c for c in private.columns if c != key and c not in guarded})


def package_audit(rows: DataFrame, key: str) -> DataFrame:
    """Totals, repeats, distinct sources and records, and blanks by feature."""
    repeated = rows.groupBy("feature", key).agg(F.count("*").alias("_n"), F.first("source").alias("source"), F.first("record_id").alias("record_id"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("_blank"))
    return repeated.groupBy("feature").agg(F.sum("_n").alias("rows"), F.count_if(F.col("_n") > 1).alias("repeated_ids"), F.count_distinct("source").alias("sources"), F.count_distinct("record_id").alias("records"), F.sum("_blank").alias("blank_texts"))


def evaluation(predictions: DataFrame, keys: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Accuracy, positive rates, mean probability and confusion counts of predictions (label 0 or 1, probability)."""
    yes, label = F.col("probability") >= threshold, F.col("label") == 1
    return predictions.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(yes & label).alias("tp"), F.count_if(yes & ~label).alias("fp"), F.count_if(~yes & label).alias("fn"), F.count_if(~yes & ~label).alias("tn"), (F.count_if(yes == label) / F.count("*")).alias("accuracy"), (F.count_if(yes) / F.count("*")).alias("predicted_share"), F.avg("probability").alias("mean_probability"))


def pairwise_ranking(rows: DataFrame, prompt: str) -> DataFrame:
    """For each prompt whether its human text scores below every other text, and the share of others above it."""
    h = F.max(F.when(F.col("human"), F.col("score"))).alias("_h")
    human = rows.groupBy(prompt).agg(h)
    others = rows.where(~F.col("human")).join(human, prompt).where("_h is not null")
    return others.groupBy(prompt).agg(F.count("*").alias("pairs"), F.count_if(F.col("score") > F.col("_h")).alias("right_pairs"), F.bool_and(F.col("score") > F.col("_h")).alias("all_right"))


def generation_audit(cache: DataFrame, per_prompt: int) -> DataFrame:
    """O1: one row of failure counters over generations (source, record_id, completion_index, tokens, text) and whether all are 0."""
    ids = ["source", "record_id", "completion_index"]
    repeats = cache.groupBy(*ids).agg(F.count("*").alias("n"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("empty"), F.count_if(F.col("tokens").isNull() | (F.col("tokens") <= 0)).alias("without_tokens"), F.count_if(F.col("completion_index") < 0).alias("negative_index"))
    prompts = repeats.groupBy("source", "record_id").agg(F.count("*").alias("c"), F.sum("n").alias("rows"), F.count_if(F.col("n") > 1).alias("repeated"), *[F.sum(x).alias(x) for x in ("empty", "without_tokens", "negative_index")])
    out = prompts.agg(F.sum("rows").alias("rows"), F.count("*").alias("prompts"), F.sum("repeated").alias("repeated_keys"), F.count_if(F.col("c") < per_prompt).alias("incomplete_prompts"), F.count_if(F.col("c") > per_prompt).alias("overfull_prompts"), F.sum("empty").alias("empty_texts"), F.sum("without_tokens").alias("without_tokens"), F.sum("negative_index").alias("negative_indexes"))
    bad = F.lit(0)
    for c in ("repeated_keys", "incomplete_prompts", "overfull_prompts", "empty_texts", "without_tokens", "negative_indexes"):
        bad = bad + F.coalesce(c, F.lit(0))
    return out.withColumn("passed", bad == 0)


def completion_audit(plan: DataFrame) -> DataFrame:
    """O2: severity of each planned cell from rows wanted and found."""
    w, f = F.col("wanted"), F.coalesce("found", F.lit(0))
    return plan.withColumn("severity", F.when(f == 0, "missing").when(f < w, "incomplete").when(f > w, "overfull").otherwise("complete")).withColumn("missing_rows", F.greatest(F.lit(0), w - f))
