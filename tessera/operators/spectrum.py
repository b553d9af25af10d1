"""Stage-by-feature spectra: assembly, classification and comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.patterns import STAGES
from ..functions.text import safe_ratio

# The thresholds of the classes.
THRESHOLDS = {"high_sft_rate": 0.25, "near_one": 0.25, "amplified": 1.25, "jump": 0.25, "relative_jump": 0.1, "delta": 0.0, "modest": 1.25, "excess": 0.1, "realized": 1.1}


def scaffold(features: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """Every feature at every stage; the stages are a literal list, so no join is needed."""
    return features.select("feature").distinct().select("feature", F.posexplode(F.array(*[F.lit(s) for s in stages])).alias("stage_order", "stage"))


def last_written(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of rows with equal keys, the last written."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.max_by(row, order).alias("_row")).select("_row.*")


def assemble(features: DataFrame, measures: Mapping[str, DataFrame], by_feature: Sequence[str] = (), stages: Sequence[str] = STAGES, order: str = "written") -> DataFrame:
    """The scaffold left-joined with each measure, whose later rows win; what is not measured stays null."""
    out = scaffold(features, stages)
    for name, df in measures.items():
        keys = ["feature"] if name in by_feature else ["feature", "stage"]
        out = out.join(last_written(df, keys, order).drop(order), keys, "left")
    return out


def classify(spectrum: DataFrame, preferences: DataFrame | None = None, thresholds: Mapping[str, float] | None = None) -> DataFrame:
    """Q12: one row for each feature. spectrum: rows (feature, stage, normalized_af, af, af_low, af_high, excess, realized_af, sft_rate, chosen_rate, rejected_rate)."""
    t = THRESHOLDS | dict(thresholds or {})
    factor = F.when(F.col("normalized_af") > 0, F.col("normalized_af")).otherwise(F.col("af"))
    staged = spectrum.withColumn("_af", factor)
    at = lambda c, s: F.max(F.when(F.col("stage") == s, F.col(c)))
    relation = F.when(F.col("af_low").isNull() | F.col("af_high").isNull() | F.col("_af").isNull(), "missing").when(F.col("af_low") > 1, "above_1").when(F.col("af_high") < 1, "below_1").otherwise("overlaps_1")
    near = (F.col("_af") >= 1 - t["near_one"]) & (F.col("_af") <= 1 + t["near_one"])
    wide = staged.withColumn("_relation", relation).groupBy("feature").agg(
        *[at("_af", s).alias(f"{s}_af") for s in STAGES],
        *[F.coalesce(at("_relation", s), F.lit("missing")).alias(f"{s}_relation") for s in STAGES],
        F.max("_af").alias("max_af"),
        F.coalesce(F.bool_and(F.when(F.col("_af").isNotNull(), near)), F.lit(False)).alias("af_approx_one"),
        F.max("excess").alias("max_excess"),
        F.max("realized_af").alias("max_realized_af"),
        *[F.max(c).alias(c) for c in ("sft_rate", "chosen_rate", "rejected_rate")],
    )
    before, after = F.greatest("base_af", "sft_af"), F.greatest("dpo_af", "final_af")
    out = wide.withColumn("jump", after - before).withColumn("relative_jump", safe_ratio(F.col("jump"), before)).withColumn("chosen_minus_rejected", F.col("chosen_rate") - F.col("rejected_rate"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    out = (
        out.withColumn("inherited", yes(F.col("sft_rate") >= t["high_sft_rate"]) & F.col("af_approx_one"))
        .withColumn("sft_amplified", yes(F.col("sft_af") >= t["amplified"]))
        .withColumn("preference_amplified", yes((after >= t["amplified"]) & (F.col("jump") >= t["jump"]) & (F.col("relative_jump") >= t["relative_jump"])))
        .withColumn("compounding_dominant", yes((F.col("max_af") <= t["modest"]) & (F.col("max_excess") >= t["excess"]) & (F.col("max_realized_af") >= t["realized"])))
    )
    if preferences is not None:
        out = out.join(preferences.select("feature", "pairs", "direction", "fdr_significant"), "feature", "left")
    else:
        out = out.withColumns({"pairs": F.lit(None).cast("long"), "direction": F.lit(None).cast("string"), "fdr_significant": F.lit(None).cast("boolean")})
    complicit = F.when(F.col("pairs").isNotNull(), yes(F.col("fdr_significant")) & yes(F.col("direction") == "chosen_gt_rejected")).otherwise(yes(F.col("chosen_minus_rejected") > t["delta"]))
    label = (
        F.when(F.col("preference_amplified"), "preference-amplified")
        .when(F.col("sft_amplified"), "sft-amplified")
        .when(F.col("compounding_dominant"), "compounding-dominant")
        .when(F.col("inherited"), "inherited")
        .when(F.col("max_af").isNotNull(), "measured-without-class")
        .otherwise("observed-output-only")
    )
    cause = F.when(~F.col("preference_amplified"), "not-preference-amplified").when(F.col("complicit"), "signal-driven").otherwise("dynamics-driven")
    return out.withColumn("complicit", complicit).withColumn("primary_class", label).withColumn("preference_cause", cause)


def best_preference(rows: DataFrame) -> DataFrame:
    """The row with the most pairs for each feature."""
    return last_written(rows, ["feature"], "pairs")


def compare(a: DataFrame, b: DataFrame, value: str, keys: Sequence[str] = ("feature", "stage")) -> DataFrame:
    """Two ladders on the keys that both have."""
    left, right = (df.select(*keys, F.col(value).alias(n)) for df, n in ((a, "left_value"), (b, "right_value")))
    return left.join(right, [*keys]).withColumn("delta", F.col("right_value") - F.col("left_value")).withColumn("ratio", safe_ratio(F.col("right_value"), F.col("left_value")))


def feature_summary(spectrum: DataFrame, value: str) -> DataFrame:
    """The stage of the largest value (the earlier of equals) and the mean."""
    known = spectrum.where(F.col(value).isNotNull())
    return known.groupBy("feature").agg(F.max_by("stage", F.struct(F.col(value), -F.col("stage_order"))).alias("max_stage"), F.max(value).alias("max_value"), F.avg(value).alias("mean_value"))


def segment_ends(df: DataFrame, within: Sequence[str], start: str, steps: int) -> DataFrame:
    """The last step of each segment: one before the next start."""
    return df.withColumn("end_step", F.lead(start, 1, steps + 1).over(Window.partitionBy(*within).orderBy(start)) - 1)
