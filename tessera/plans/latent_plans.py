"""Sparse-activation queries over the embeddings.

An embedding is a document's token vector, its eight largest components are active latents, and the
label is the source; masses are component values in whole 1/1024, so sums are exact.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import latents, sampling, sparse_codes
from .base import query, table

_TOP = "list_sort(list_transform(range(1, len(embedding) + 1), lambda i: {'m': -embedding[i], 'i': i - 1}))[1:8]"
LONG = f"t AS (SELECT vec_id, label, unnest({_TOP}) AS u FROM embeddings), l AS (SELECT vec_id // 4 AS doc, vec_id AS token, CASE WHEN label < 3 THEN 'human' ELSE 'm' || label::VARCHAR END AS source, u.i::INT AS latent, floor(-u.m::DOUBLE * 1024) / 1024 AS value FROM t WHERE floor(-u.m::DOUBLE * 1024) <> 0)"


def long_codes(spark, d):
    e = table(spark, d, "embeddings").withColumn("p", sampling.sparse_top(F.col("embedding"), 8))
    codes = e.select((F.col("vec_id") / 4).cast("long").alias("doc"), F.col("vec_id").alias("token"), F.when(F.col("label") < 3, "human").otherwise(F.concat(F.lit("m"), F.col("label").cast("string"))).alias("source"), F.transform("p", lambda x: x["index"]).alias("ids"), F.transform("p", lambda x: F.floor(x["value"].cast("double") * 1024) / F.lit(1024.0)).alias("values"))
    return latents.exploded(codes, ["doc", "token", "source"], "ids", "values")


@query("t12_sparse_top", f"SELECT vec_id, list_transform({_TOP}, lambda x: x.i)::VARCHAR AS ids FROM embeddings")
def t12(spark, d):
    p = sampling.sparse_top(F.col("embedding"), 8)
    return table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("["), F.array_join(F.transform(p, lambda x: x["index"].cast("string")), ", "), F.lit("]")).alias("ids"))


@query("a24_source_statistics", f"WITH {LONG}, s AS (SELECT latent, sum(value) FILTER (WHERE source <> 'human') AS am, sum(value) FILTER (WHERE source = 'human') AS hm, count(*) AS active, max(value) AS mx FROM l GROUP BY 1), n AS (SELECT count(*) FILTER (WHERE label >= 3) AS ats, count(*) FILTER (WHERE label < 3) AS hts FROM embeddings) SELECT latent, coalesce(am, 0) AS ai_mass, coalesce(hm, 0) AS human_mass, mx AS max_activation, round(ln((coalesce(am, 0) / ats + 1e-6) / (coalesce(hm, 0) / hts + 1e-6)), 8) AS log_odds, active::DOUBLE / (ats + hts) AS active_token_rate FROM s, n")
def a24(spark, d):
    return statistics(spark, d).select("latent", "ai_mass", "human_mass", "max_activation", F.round("log_odds", 8).alias("log_odds"), "active_token_rate")


def statistics(spark, d):
    e = table(spark, d, "embeddings").withColumn("source", F.when(F.col("label") < 3, "human").otherwise(F.concat(F.lit("m"), F.col("label").cast("string"))))
    totals = e.groupBy("source").agg(F.count("*").alias("tokens"), F.count_distinct((F.col("vec_id") / 4).cast("long")).alias("docs"))
    return latents.source_statistics(long_codes(spark, d), totals, "human")


@query("a36_ranked_candidates")
def a36(spark, d):
    return latents.ranked_candidates(statistics(spark, d).withColumn("effect", F.col("ai_mass") - F.col("human_mass")), "effect", 20).select("latent", "score", "category", "rank")


@query("a25_document_maxima", f"WITH {LONG} SELECT latent, doc, max(value) AS max_value, min(token) FILTER (WHERE value = m) AS peak_token FROM (SELECT *, max(value) OVER (PARTITION BY latent, doc) AS m FROM l) GROUP BY latent, doc")
def a25(spark, d):
    return latents.document_maxima(long_codes(spark, d))


_SUMMARY = "d AS (SELECT doc, latent, sum(value) AS mass, count(*) AS tokens, max(value) AS max_value FROM l GROUP BY ALL)"


@query("a26_document_summary", f"WITH {LONG}, {_SUMMARY} SELECT doc, latent, mass, tokens, max_value FROM d QUALIFY row_number() OVER (PARTITION BY doc ORDER BY max_value DESC, mass DESC, latent) <= 5")
def a26(spark, d):
    return latents.document_summary(long_codes(spark, d), 5).drop("peak_token")


@query("w06_examples", f"WITH {LONG}, m AS (SELECT latent, doc, max(value) AS max_value FROM l GROUP BY ALL) SELECT latent, doc, max_value FROM m QUALIFY row_number() OVER (PARTITION BY latent ORDER BY max_value DESC, doc) <= 3")
def w06(spark, d):
    return latents.examples(long_codes(spark, d), 3).drop("peak_token")


@query("a28_prompt_contrast", f"WITH {LONG} SELECT latent, doc % 10 AS prompt, avg(value) FILTER (WHERE source = 'human') - avg(value) FILTER (WHERE source <> 'human') AS contrast FROM l GROUP BY ALL".replace("avg(value) FILTER (WHERE source = 'human') - avg(value) FILTER (WHERE source <> 'human')", "round(avg(value) FILTER (WHERE source = 'human') - avg(value) FILTER (WHERE source <> 'human'), 9)"))
def a28(spark, d):
    effects = long_codes(spark, d).select("latent", (F.col("doc") % 10).alias("prompt"), F.col("source").alias("model"), F.col("value").alias("effect"), "doc")
    return latents.prompt_contrast(effects, "human").select("latent", "prompt", F.round("contrast", 9).alias("contrast"))


@query("a27_peak_profile", "WITH t AS (SELECT lang, trim(unnest(string_split(text, ' '))) AS t FROM documents), c AS (SELECT lang, t, count(*) AS n FROM t GROUP BY ALL), b AS (SELECT lang, string_agg(t, ' ' ORDER BY r) AS top_tokens FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, t) AS r FROM c) WHERE r <= 8 GROUP BY lang) SELECT lang, count(*) AS peaks, count(*) FILTER (WHERE t = '.')::DOUBLE / count(*) AS period_share, count(*) FILTER (WHERE regexp_full_match(t, '[^\\p{L}\\p{N}_\\s]+'))::DOUBLE / count(*) AS punctuation_share, count(*) FILTER (WHERE regexp_full_match(t, '[\\p{L}\\p{N}_]+'))::DOUBLE / count(*) AS word_share, any_value(top_tokens) AS top_tokens FROM t JOIN b USING (lang) GROUP BY lang")
def a27(spark, d):
    peaks = table(spark, d, "documents").select("lang", F.explode(F.split("text", " ")).alias("token"))
    return latents.peak_profile(peaks, ["lang"], "token")


@query("a35_histogram", f"WITH {LONG}, m AS (SELECT *, max(value) OVER (PARTITION BY source) AS mx FROM l) SELECT source, least(15, floor(value / mx * 16)::INT) AS bin, count(*) AS n FROM m GROUP BY ALL")
def a35(spark, d):
    return latents.histogram(long_codes(spark, d), ["source"], "value")


_NODES = "n AS (SELECT latent % 3 AS layer, latent, list_sort(list_distinct(list(doc))) AS prompts FROM l GROUP BY ALL)"


def nodes(spark, d):
    return long_codes(spark, d).groupBy((F.col("latent") % 3).alias("layer"), "latent").agg(F.array_sort(F.collect_set("doc")).alias("prompts"))


_EDGES = "x AS (SELECT a.layer AS left_layer, a.latent AS left_latent, b.layer AS right_layer, b.latent AS right_latent, len(list_intersect(a.prompts, b.prompts)) AS shared, len(a.prompts) AS ln, len(b.prompts) AS rn FROM n a JOIN n b ON b.layer = a.layer + 1), e AS (SELECT left_layer, left_latent, right_layer, right_latent, shared, shared::DOUBLE / (ln + rn - shared) AS jaccard FROM x WHERE shared >= 3)"


@query("j19_overlap_edges", f"WITH {LONG}, {_NODES}, {_EDGES} SELECT * FROM e")
def j19(spark, d):
    return latents.overlap_edges(nodes(spark, d), [(0, 1), (1, 2)], 3)


@query("j20_chains", f"WITH {LONG}, {_NODES}, {_EDGES}, r AS (SELECT *, row_number() OVER (PARTITION BY left_layer, left_latent ORDER BY jaccard DESC, right_layer, right_latent) AS r FROM e) SELECT a.left_latent || ' -> ' || a.right_latent || ' -> ' || b.right_latent AS chain, round(sqrt(a.jaccard * b.jaccard), 9) AS score FROM e a JOIN r b ON a.right_latent = b.left_latent AND b.left_layer = 1 AND b.right_layer = 2 AND b.r <= 8 WHERE a.left_layer = 0 AND a.right_layer = 1")
def j20(spark, d):
    edges = latents.overlap_edges(nodes(spark, d), [(0, 1), (1, 2)], 3).withColumn("score", F.col("jaccard"))
    return latents.chains(edges, [0, 1, 2], 8, 1_000_000).withColumn("score", F.round("score", 9))


@query("w11_rises", f"WITH {LONG} SELECT doc, latent, token, greatest(0, value - coalesce(lag(value) OVER (PARTITION BY doc, latent ORDER BY token), 0)) AS rise FROM l")
def w11(spark, d):
    return latents.rises(long_codes(spark, d), ["doc", "latent"], "token", "value").select("doc", "latent", "token", "rise")


@query("w13_controls", f"WITH {LONG}, n AS (SELECT latent, list_sort(list_distinct(list(doc))) AS prompts, latent AS rank FROM l GROUP BY latent), m AS (SELECT t.latent AS target, c.latent, abs(c.rank - t.rank) + 25 * len(list_intersect(c.prompts, t.prompts)) AS cost FROM n t JOIN n c ON t.latent <> c.latent AND abs(t.rank // 50 - c.rank // 50) <= 1) SELECT target, latent, cost FROM m QUALIFY row_number() OVER (PARTITION BY target ORDER BY cost, latent) <= 2")
def w13(spark, d):
    ranked = long_codes(spark, d).groupBy("latent").agg(F.array_sort(F.collect_set("doc")).alias("prompts")).withColumn("rank", F.col("latent"))
    return latents.controls(ranked, ranked, [], 2)


@query("j22_peak_tokens", "SELECT doc_id, string_split(text, ' ')[least(3, len(string_split(text, ' ')))] AS token FROM documents")
def j22(spark, d):
    w = F.split("text", " ")
    at = F.array_position(F.transform(w, lambda x, i: i + 1), F.least(F.lit(3), F.size(w)))
    return table(spark, d, "documents").select("doc_id", F.element_at(w, at.cast("int")).alias("token"))


@query("x44_peak_windows", "SELECT doc_id, substr(text, 6, 5) || '[[' || substr(text, 11, 6) || ']]' || substr(text, 17, 5) AS shown FROM documents WHERE len(text) > 30")
def x44(spark, d):
    return table(spark, d, "documents").where(F.length("text") > 30).select("doc_id", latents.peak_window(F.col("text"), F.lit(10), F.lit(16), 5).alias("shown"))


@query("t15_token_contexts", "WITH v AS (SELECT vec_id, embedding AS e, list_position(embedding, list_max(embedding)) AS peak FROM embeddings) SELECT vec_id, greatest(1, peak - 2)::INT AS first, least(len(e), peak + 2)::INT AS last FROM v")
def t15(spark, d):
    tokens = F.transform(F.col("embedding"), lambda x, i: i + 1)
    c = latents.token_context(tokens, F.col("embedding").cast("array<double>"), 2)
    return table(spark, d, "embeddings").select("vec_id", c.alias("c")).select("vec_id", F.element_at("c", 1)["token"].alias("first"), F.element_at("c", -1)["token"].alias("last"))


@query("a37_enrichment", f"WITH {LONG}, s AS (SELECT latent, coalesce(sum(value) FILTER (WHERE source <> 'human'), 0) AS am, coalesce(sum(value) FILTER (WHERE source = 'human'), 0) AS hm FROM l GROUP BY 1), n AS (SELECT count(*) FILTER (WHERE label >= 3) AS ats, count(*) FILTER (WHERE label < 3) AS hts FROM embeddings) SELECT latent, am AS ai_mass, hm AS human_mass, round(ln((am / greatest(1, ats) + 1e-6) / (hm / greatest(1, hts) + 1e-6)), 8) AS log_odds FROM s, n WHERE am + hm > 0")
def a37(spark, d):
    totals = table(spark, d, "embeddings").groupBy(F.when(F.col("label") < 3, "human").otherwise(F.concat(F.lit("m"), F.col("label").cast("string"))).alias("source")).agg(F.count("*").alias("tokens"))
    return latents.enrichment(long_codes(spark, d), totals, "human", 1_000_000).select("latent", "ai_mass", "human_mass", F.round("log_odds", 8).alias("log_odds"))


@query("o10_control_panel", "WITH p AS (SELECT s_nationkey AS target, CASE WHEN s_suppkey % 2 = 0 THEN 'different_upstream_same_downstream' ELSE 'same_upstream_different_downstream' END AS t, s_suppkey AS k FROM supplier), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target, t ORDER BY k) AS i FROM p) WHERE i <= 2) SELECT target, label, 'anchor' AS control_type, nodes FROM (SELECT DISTINCT target FROM p), (VALUES ('anchor_upstream_only', 'U'), ('anchor_downstream_only', 'D'), ('anchor_joint', 'U+D')) a(label, nodes) UNION ALL SELECT target, CASE WHEN t LIKE 'diff%' THEN 'control_upstream_only_' ELSE 'control_downstream_only_' END || i, t, k::VARCHAR FROM f UNION ALL SELECT target, CASE WHEN t LIKE 'diff%' THEN 'control_upstream_plus_anchor_downstream_' ELSE 'anchor_upstream_plus_control_downstream_' END || i, t, CASE WHEN t LIKE 'diff%' THEN k::VARCHAR || '+D' ELSE 'U+' || k::VARCHAR END FROM f")
def o10(spark, d):
    k = F.col("s_suppkey")
    kind = F.when(k % 2 == 0, "different_upstream_same_downstream").otherwise("same_upstream_different_downstream")
    panel = table(spark, d, "supplier").select(F.col("s_nationkey").alias("target"), kind.alias("control_type"), k.cast("string").alias("upstream"), k.cast("string").alias("downstream"), F.lit("U").alias("chain_upstream"), F.lit("D").alias("chain_downstream"), k.alias("position"))
    return latents.control_panel(panel, 2)


@query("a38_token_summary", f"WITH {LONG}, k AS (SELECT doc, source, count(*) AS n FROM l GROUP BY ALL), h AS (SELECT doc, string_agg(source || ':' || n::VARCHAR, ';' ORDER BY n DESC, source) AS classes FROM k GROUP BY doc), b AS (SELECT doc, token, value FROM l QUALIFY row_number() OVER (PARTITION BY doc ORDER BY value DESC, token, latent) <= 4), z AS (SELECT doc, string_agg(token::VARCHAR, ';' ORDER BY value DESC, token) AS top_tokens FROM b GROUP BY doc), s AS (SELECT doc, sum(value) AS mass, max(value) AS max_value, count(*) AS tokens FROM l GROUP BY doc) SELECT doc, mass, max_value, tokens, classes, top_tokens FROM s JOIN h USING (doc) JOIN z USING (doc)")
def a38(spark, d):
    return latents.token_summary(long_codes(spark, d), "source", 4)


@query("g06_sparse_codes")
def g06(spark, d):
    """Codes of all embeddings by an autoencoder that learns from them: the 8 * n largest activations of n rows, and each row's error."""
    vectors = table(spark, d, "embeddings")
    if sparse_codes.dimensions(vectors, "embedding") is None:  # nothing to learn from
        codes = sparse_codes.encode(vectors, "vec_id", "embedding", sparse_codes.started(1, 1), 8)
    else:
        model, _ = sparse_codes.train(vectors, "vec_id", "embedding", latents=256, k=8, steps=12, batch_rows=4096, spare_k=4)
        codes = sparse_codes.encode(vectors, "vec_id", "embedding", model, 8)
    return codes.select(F.col("item").alias("vec_id"), F.size("ids").alias("active"), "ids", "values", "error")
