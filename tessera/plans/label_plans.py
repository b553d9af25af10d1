"""Annotation, evaluation and audit queries.

Labels are derived from documents and orders: two annotators are two rules that mostly agree.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotation, joins, sampling, stats
from ..sources import records as R
from .base import query, table

_LABEL = "list_value('exact', 'partial', 'false_positive', 'ambiguous')[(p_partkey * 7 % 13 % 4) + 1]"


def _labels(spark, d):
    label = F.element_at(F.array(*[F.lit(x) for x in ("exact", "partial", "false_positive", "ambiguous")]), (F.col("p_partkey") * 7 % 13 % 4 + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_brand").alias("feature"), label.alias("label"), "p_partkey")


@query("a19_precision", f"WITH c AS (SELECT p_brand AS feature, count(*) AS labeled, count(*) FILTER (WHERE l = 'exact') AS exact, count(*) FILTER (WHERE l = 'partial') AS partial, count(*) FILTER (WHERE l = 'false_positive') AS false_positive, count(*) FILTER (WHERE l = 'ambiguous') AS ambiguous FROM (SELECT p_brand, {_LABEL} AS l FROM part) GROUP BY 1) SELECT *, exact::DOUBLE / labeled AS precision, ambiguous::DOUBLE / labeled AS ambiguous_rate, exact::DOUBLE / labeled >= 0.25 AS precision_pass, ambiguous::DOUBLE / labeled <= 0.25 AS ambiguity_pass, true AS sample_size_pass, CASE WHEN exact::DOUBLE / labeled >= 0.25 AND ambiguous::DOUBLE / labeled <= 0.25 THEN 'pass' ELSE 'demote' END AS status FROM c")
def a19(spark, d):
    return annotation.precision(_labels(spark, d), target=0.25, most_ambiguous=0.25)


_PERCEPTION = "list_value('yes', 'no', 'context_dependent', 'unclear', '')[(s_suppkey * 11 % 17 % 5) + 1]"
_TAXONOMY = "CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE 't' || (s_suppkey % 3)::VARCHAR END"


@query("a20_regions", f"WITH r AS (SELECT s_nationkey AS feature, {_PERCEPTION} AS p, {_TAXONOMY} AS t FROM supplier), c AS (SELECT feature, count(*) AS total, count(*) FILTER (WHERE p = 'yes') AS yes, count(*) FILTER (WHERE p = 'context_dependent') AS context_dependent, count(*) FILTER (WHERE p = 'no') AS no, count(*) FILTER (WHERE p = 'unclear') AS unclear, count(*) FILTER (WHERE p <> '') AS labeled FROM r GROUP BY 1), m AS (SELECT feature, t FROM (SELECT feature, t, count(*) AS n FROM r WHERE t <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY feature ORDER BY n DESC, t DESC) = 1) SELECT c.*, coalesce(m.t, '') AS top_taxonomy, CASE WHEN labeled = 0 THEN 'unlabeled' WHEN yes::DOUBLE / labeled >= 0.5 OR (yes + context_dependent)::DOUBLE / labeled >= 0.65 THEN 'detector_and_human_perceived' WHEN no::DOUBLE / labeled >= 0.5 AND labeled >= least(20, total) THEN 'detector_only_or_domain_artifact' ELSE 'mixed_or_unresolved' END AS region FROM c LEFT JOIN m USING (feature)")
def a20(spark, d):
    k = F.col("s_suppkey")
    p = F.element_at(F.array(*[F.lit(x) for x in ("yes", "no", "context_dependent", "unclear", "")]), (k * 11 % 17 % 5 + 1).cast("int"))
    t = F.when(k % 6 == 0, "").otherwise(F.concat(F.lit("t"), (k % 3).cast("string")))
    return annotation.regions(table(spark, d, "supplier").select(F.col("s_nationkey").alias("feature"), p.alias("perception"), t.alias("taxonomy")))


_A = "CASE o_orderkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'unclear' ELSE '' END"
_B = "CASE WHEN o_orderkey % 11 = 0 THEN 'no' ELSE " + _A + " END"
_PAIRS = f"p AS (SELECT o_orderkey AS blind_id, o_orderpriority AS feature, {_A} AS a, {_B} AS b FROM orders)"


def _sides(spark, d):
    k = F.col("o_orderkey")
    a = F.when(k % 4 == 0, "yes").when(k % 4 == 1, "no").when(k % 4 == 2, "unclear").otherwise("")
    b = F.when(k % 11 == 0, "no").otherwise(a)
    orders = table(spark, d, "orders")
    side = lambda c: orders.select(k.alias("blind_id"), F.col("o_orderpriority").alias("feature"), c.alias("label"))
    return side(a), side(b)


def _met(spark, d):
    return annotation.met(*_sides(spark, d), "blind_id", "label")


@query("j09_annotators_met", f"WITH {_PAIRS} SELECT * FROM p")
def j09(spark, d):
    return _met(spark, d)


_KAPPA = "l AS (SELECT unnest([feature, 'ALL']) AS feature, a, b FROM p WHERE a <> '' AND b <> ''), o AS (SELECT feature, count(*) AS n, count(*) FILTER (WHERE a = b) AS agreed FROM l GROUP BY 1), e AS (SELECT x.feature, sum(x.n * y.n) AS c FROM (SELECT feature, a AS v, count(*) AS n FROM l GROUP BY ALL) x JOIN (SELECT feature, b AS v, count(*) AS n FROM l GROUP BY ALL) y ON x.feature = y.feature AND x.v = y.v GROUP BY x.feature), k AS (SELECT feature, round((agreed::DOUBLE / n - c::DOUBLE / (n * n)) / (1 - c::DOUBLE / (n * n)), 9) AS kappa FROM o JOIN e USING (feature))"


@query("a21_agreement", f"WITH {_PAIRS}, g AS (SELECT CASE WHEN grouping(feature) = 1 THEN 'ALL' ELSE feature END AS feature, count(*) AS rows_compared, count(*) FILTER (WHERE a <> '' AND b <> '') AS both_labeled, count(*) FILTER (WHERE a <> '' AND a = b) AS agreed, count(*) FILTER (WHERE a = 'yes' AND b = 'no' OR a = 'no' AND b = 'yes') AS yes_no_conflicts FROM p GROUP BY ROLLUP (feature)), {_KAPPA} SELECT g.*, kappa, agreed::DOUBLE / both_labeled AS agreement_rate FROM g LEFT JOIN k USING (feature)")
def a21(spark, d):
    return annotation.agreement(_met(spark, d)).withColumn("kappa", F.round("kappa", 9))


@query("q11_kappa", f"WITH {_PAIRS}, {_KAPPA} SELECT k.feature, o.n, o.agreed, o.agreed::DOUBLE / o.n AS agreement, kappa FROM k JOIN o USING (feature) WHERE feature <> 'ALL'")
def q11(spark, d):
    both = _met(spark, d).where("a <> '' and b <> ''")
    return stats.kappa(both, "a", "b", ["feature"]).withColumn("kappa", F.round("kappa", 9))


@query("j10_adjudicated", f"WITH {_PAIRS} SELECT blind_id, feature, a, b, CASE WHEN a <> b AND blind_id % 2 = 0 THEN 'decided' END AS decision, CASE WHEN a = b THEN a WHEN blind_id % 2 = 0 THEN 'decided' END AS final, a <> b AND blind_id % 2 = 1 AS open FROM p")
def j10(spark, d):
    met = _met(spark, d)
    decisions = met.where("a <> b and blind_id % 2 = 0").select("blind_id", F.lit("decided").alias("label"))
    return annotation.adjudicated(met, decisions, "blind_id")


@query("j11_unblinded", f"WITH {_PAIRS} SELECT blind_id, feature, a AS label, o_custkey AS record FROM p JOIN orders ON blind_id = o_orderkey")
def j11(spark, d):
    blind, _ = _sides(spark, d)
    private = table(spark, d, "orders").select(F.col("o_orderkey").alias("blind_id"), F.col("o_orderpriority").alias("feature"), F.col("o_custkey").alias("record"))
    return annotation.unblinded(blind, private, "blind_id", ["feature"])


@query("a22_package_audit", "WITH k AS (SELECT lang AS feature, md5(text) AS id, count(*) AS n, min(source) AS source, min(doc_id) AS record_id, 0 AS blank FROM documents GROUP BY ALL) SELECT feature, sum(n)::BIGINT AS rows, count(*) FILTER (WHERE n > 1) AS repeated_ids, sum(blank)::BIGINT AS blank_texts FROM k GROUP BY feature")
def a22(spark, d):
    rows = table(spark, d, "documents").select(F.col("lang").alias("feature"), F.md5("text").alias("id"), "source", F.col("doc_id").alias("record_id"), "text")
    return annotation.package_audit(rows, "id").select("feature", "rows", "repeated_ids", "blank_texts")


@query("a23_evaluation", "WITH p AS (SELECT lang, quality AS label, (doc_id % 64) / 64.0::DOUBLE AS probability FROM documents JOIN labels USING (doc_id)) SELECT lang, count(*) AS n, count(*) FILTER (WHERE probability >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE probability >= 0.5 AND label = 0) AS fp, count(*) FILTER (WHERE probability < 0.5 AND label = 1) AS fn, count(*) FILTER (WHERE probability < 0.5 AND label = 0) AS tn, count(*) FILTER (WHERE (probability >= 0.5) = (label = 1))::DOUBLE / count(*) AS accuracy, count(*) FILTER (WHERE probability >= 0.5)::DOUBLE / count(*) AS predicted_share, avg(probability) AS mean_probability FROM p GROUP BY lang")
def a23(spark, d):
    p = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("lang", F.col("quality").alias("label"), ((F.col("doc_id") % 64) / F.lit(64.0)).alias("probability"))
    return annotation.evaluation(p, ["lang"])


@query("a23_pairwise_ranking", "WITH h AS (SELECT source, max(n_chars) AS h FROM documents WHERE lang = 'es' GROUP BY source) SELECT source, count(*) AS pairs, count(*) FILTER (WHERE n_chars > h) AS right_pairs, bool_and(n_chars > h) AS all_right FROM documents JOIN h USING (source) WHERE lang <> 'es' GROUP BY source")
def a23_ranking(spark, d):
    return annotation.pairwise_ranking(table(spark, d, "documents").select("source", (F.col("lang") == "es").alias("human"), F.col("n_chars").alias("score")), "source")


@query("o01_generation_audit", "WITH g AS (SELECT event_type AS source, user_id AS record_id, event_id % 3 AS completion_index, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT source, record_id, count(*) AS c, sum(n) AS rows, count(*) FILTER (WHERE n > 1) AS repeated FROM g GROUP BY ALL) SELECT sum(rows)::BIGINT AS rows, count(*) AS prompts, sum(repeated)::BIGINT AS repeated_keys, count(*) FILTER (WHERE c < 3) AS incomplete_prompts, count(*) FILTER (WHERE c > 3) AS overfull_prompts, 0::BIGINT AS empty_texts, 0::BIGINT AS without_tokens, 0::BIGINT AS negative_indexes, sum(repeated) + count(*) FILTER (WHERE c < 3) = 0 AS passed FROM p")
def o01(spark, d):
    cache = table(spark, d, "events").select(F.col("event_type").alias("source"), F.col("user_id").alias("record_id"), (F.col("event_id") % 3).alias("completion_index"), F.lit(5).alias("tokens"), F.lit("x").alias("text"))
    return annotation.generation_audit(cache, 3)


@query("o02_completion_audit", "WITH f AS (SELECT n_nationkey, count(s_suppkey) AS found FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1) SELECT n_nationkey, 4 AS wanted, found, CASE WHEN found = 0 THEN 'missing' WHEN found < 4 THEN 'incomplete' WHEN found > 4 THEN 'overfull' ELSE 'complete' END AS severity, greatest(0, 4 - found) AS missing_rows FROM f")
def o02(spark, d):
    found = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("found"))
    plan = table(spark, d, "nation").select("n_nationkey", F.lit(4).alias("wanted")).join(found, "n_nationkey", "left").withColumn("found", F.coalesce("found", F.lit(0).cast("long")))
    return annotation.completion_audit(plan)


@query("o03_plan", "SELECT n_name AS feature, s.stage, t.temperature FROM nation, (VALUES ('base'), ('sft'), ('dpo'), ('final')) s(stage), (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) t(temperature)")
def o03(spark, d):
    from ..operators.spectrum import scaffold

    cells = scaffold(table(spark, d, "nation").select(F.col("n_name").alias("feature")))
    return cells.select("feature", "stage", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("temperature"))


@query("o05_budget_shards")
def o05(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return sampling.budget_shards(rows, "doc_id", "n_chars", 20_000, ["source"])


@query("s12_provider_texts", "SELECT doc_id, md5(text) AS generated FROM documents")
def s12(spark, d):
    t = F.col("text")
    shapes = [
        F.to_json(F.struct(F.array(F.struct(F.array(F.struct(t.alias("text"))).alias("content"))).alias("output"))),
        F.to_json(F.struct(F.array(F.struct(F.struct(t.alias("content")).alias("message"))).alias("choices"))),
        F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(t.alias("text"))).alias("parts")).alias("content"))).alias("candidates"))),
        F.to_json(F.struct(F.array(F.struct(t.alias("text"))).alias("content"))),
    ]
    raw = F.element_at(F.array(*shapes), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.md5(R.provider_text(F.parse_json(raw))).alias("generated"))


@query("s13_ordered_labels", "SELECT n_nationkey::VARCHAR AS latent_id, n_name AS label FROM nation ORDER BY n_nationkey")
def s13(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("latent_id"), F.col("n_name").alias("label")).orderBy(F.col("latent_id").cast("int"))


@query("k09_upserted_labels", "SELECT n_nationkey AS latent_id, CASE WHEN n_nationkey < 5 THEN 'new' ELSE n_name END AS label FROM nation WHERE n_nationkey NOT BETWEEN 20 AND 22")
def k09(spark, d):
    old = table(spark, d, "nation").select(F.col("n_nationkey").alias("latent_id"), F.col("n_name").alias("label"))
    change = old.where("latent_id < 5 or latent_id between 20 and 22").select("latent_id", F.lit("new").alias("label"), (F.col("latent_id") >= 20).alias("deleted"))
    return joins.union_last(old, change, ["latent_id"])
