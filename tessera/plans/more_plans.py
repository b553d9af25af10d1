"""The rest of the inventory over whole tables (F, J, K, N, O, Q, S, T, U, W, X and contracts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import spans, text
from ..operators import annotation, beam, bootstrap, classifier, density, intervals, joins, rates, sampling, stats
from ..operators import language_model as lm
from ..sources import provider
from ..sources import records as R
from . import measure_plans as M
from .base import TOKENS, documents, query, table



@query("f03_feature_selection", f"WITH {M.AF} SELECT stage, feature, amplification_factor FROM f WHERE feature IN ('view', 'click')")
def f03(spark, d):
    return M.factors(spark, d).where(F.col("feature").isin("view", "click")).select("stage", "feature", "amplification_factor")


@query("f04_reference_present", "SELECT doc_id FROM documents WHERE regexp_matches(regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g'), '(?i)\\bof\\s+the\\b')")
def f04(spark, d):
    found = documents(spark, d).withColumn("o", spans.opportunity_function(("neutral_common_of_the",))(F.col("text")))
    return found.where(F.exists("o", lambda o: o["initiates"])).select("doc_id")


@query("f06_code_lines", "SELECT doc_id, len(list_filter(string_split(text, E'\\n'), lambda l: contains(l, '|') OR contains(l, '{') OR contains(l, '}') OR contains(l, '[') OR contains(l, ']') OR contains(l, '`') OR regexp_matches(l, '\\b(?:def|class|import|from|return|lambda|const|let|var)\\b') OR regexp_matches(l, '\\b[a-zA-Z_][\\w.]*\\s*='))) AS code_lines FROM documents")
def f06(spark, d):
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[{}\[\]`|]") | x.rlike("(?U)" + P.CODE_WORDS) | x.rlike(P.ASSIGNMENT))
    return table(spark, d, "documents").select("doc_id", F.size(lines).cast("long").alias("code_lines"))


@query("f10_peak_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_discount <= 0.05 AND l_tax < 0.04 AND l_extendedprice > 1000")
def f10(spark, d):
    keep = (F.col("l_quantity") >= 10) & (F.col("l_discount") <= 0.05) & (F.col("l_tax") < 0.04) & (F.col("l_extendedprice") > 1000)
    return table(spark, d, "lineitem").where(keep).select("l_orderkey", "l_linenumber")


@query("f12_valid_tokens", "SELECT t AS token, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS t FROM documents) WHERE regexp_full_match(t, '[A-Za-z]{2,}') AND NOT regexp_matches(t, '[a-z][A-Z]') AND NOT regexp_full_match(t, '[A-Z]+') GROUP BY t HAVING count(*) > 50")
def f12(spark, d):
    t = F.col("token")
    valid = t.rlike("^[A-Za-z]{2,}$") & ~t.rlike("[a-z][A-Z]") & ~t.rlike("^[A-Z]+$")
    return table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("token")).where(valid).groupBy("token").agg(F.count("*").alias("n")).where("n > 50")


@query("f13_search", "SELECT p_partkey FROM part WHERE contains(p_partkey::VARCHAR, '12') OR contains(lower(p_name), '12')")
def f13(spark, d):
    return table(spark, d, "part").where(F.col("p_partkey").cast("string").contains("12") | F.lower("p_name").contains("12")).select("p_partkey")


@query("j05_unique_effects", f"WITH {M.AF}, s1 AS (SELECT * FROM f WHERE stage = 'sft'), s2 AS (SELECT * FROM f WHERE stage = 'dpo') SELECT feature, s1.amplification_factor AS before, s2.amplification_factor AS after, s2.amplification_factor - s1.amplification_factor AS delta FROM s1 JOIN s2 USING (feature)")
def j05(spark, d):
    f = M.factors(spark, d)
    return joins.matched_effects(f.where("stage = 'sft'"), f.where("stage = 'dpo'"), ["feature"], "amplification_factor")


@query("j13_recipe_weights", "SELECT n_name, c_mktsegment, sum(c_acctbal * 0 + n_regionkey)::DOUBLE AS weighted FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def j13(spark, d):
    joined = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", "c_mktsegment").agg(F.sum(F.col("n_regionkey").cast("double")).alias("weighted"))


@query("j24_plan_status", "SELECT n_nationkey, count(s_suppkey) FILTER (WHERE s_acctbal > 0) AS done, count(s_suppkey) FILTER (WHERE s_acctbal <= 0) AS in_flight, CASE WHEN count(s_suppkey) = 0 THEN 'missing' WHEN count(*) FILTER (WHERE s_acctbal <= 0) > 0 THEN 'in_flight' ELSE 'done' END AS status FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey")
def j24(spark, d):
    b = F.col("s_acctbal")
    seen = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count_if(b > 0).alias("done"), F.count_if(b <= 0).alias("in_flight"))
    out = table(spark, d, "nation").select("n_nationkey").join(seen, "n_nationkey", "left").fillna(0)
    return out.withColumn("status", F.when(F.col("done") + F.col("in_flight") == 0, "missing").when(F.col("in_flight") > 0, "in_flight").otherwise("done"))


@query("j26_means_and_intervals", "SELECT m.feature, m.value, i.low, i.high FROM (SELECT event_type AS feature, round(avg(value), 6) AS value FROM events GROUP BY 1) m LEFT JOIN (SELECT event_type AS feature, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high FROM events GROUP BY 1) i USING (feature)")
def j26(spark, d):
    e = table(spark, d, "events").withColumnRenamed("event_type", "feature")
    means = e.groupBy("feature").agg(F.round(F.avg("value"), 6).alias("value"))
    bounds = e.groupBy("feature").agg(*[F.round(F.percentile("value", F.lit(q)), 6).alias(n) for n, q in (("low", 0.025), ("high", 0.975))])
    return means.join(bounds, "feature", "left")


@query("a30_panel_summary", "SELECT event_type, round(avg(value - 50), 6) AS mean_effect, round(avg(abs(value - 50)), 6) AS mean_absolute FROM events GROUP BY 1")
def a30(spark, d):
    e = F.col("value") - 50
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg(e), 6).alias("mean_effect"), F.round(F.avg(F.abs(e)), 6).alias("mean_absolute"))


@query("a33_throughput", f"SELECT source, count(*) AS docs, sum({TOKENS})::BIGINT AS tokens, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source")
def a33(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.sum(text.tokens(F.col("text"))).alias("tokens"), F.sum("n_chars").alias("chars"))


@query("n05_pair_ids", "SELECT conv_id AS row_index, CASE WHEN conv_id % 2 = 0 THEN 'p' || conv_id ELSE conv_id::VARCHAR END AS record_id FROM (SELECT DISTINCT conv_id FROM conversations)")
def n05(spark, d):
    c = F.col("conv_id")
    pair = F.when(c % 2 == 0, F.concat(F.lit("p"), c.cast("string")))
    raw = F.parse_json(F.to_json(F.struct(c.cast("string").alias("id"), pair.alias("pair_id"))))
    rows = table(spark, d, "conversations").select("conv_id").distinct().select(c.alias("row_index"), raw.alias("raw"))
    return rows.select("row_index", R.record_id(F.col("raw"), R.pair_first(), "chats", None, F.col("row_index")).alias("record_id"))


@query("n10_pairs_only", "SELECT doc_id::VARCHAR AS pair_id, unnest(['chosen', 'rejected']) AS role FROM documents WHERE doc_id % 2 = 0")
def n10(spark, d):
    even = F.col("doc_id") % 2 == 0
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("record_id"), F.when(even, F.col("text")).alias("chosen"), F.when(even, F.col("text")).alias("rejected"), "text")
    return R.measured(rows, pairs_only=True).select("pair_id", "role")


@query("n12_provenance", "SELECT doc_id, coalesce(CASE WHEN doc_id % 4 = 0 THEN lang END, source, 'unknown') AS provenance FROM documents")
def n12(spark, d):
    values = F.create_map(F.lit("source_dataset"), F.when(F.col("doc_id") % 4 == 0, F.col("lang")), F.lit("source"), F.col("source"))
    return table(spark, d, "documents").select("doc_id", R.provenance(values).alias("provenance"))


@query("n19_rate_roles", "SELECT role, count(*) AS n FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'chosen' WHEN source LIKE '%1' THEN 'pretrain_document' WHEN source LIKE '%2' THEN 'target_response' ELSE 'text' END AS role FROM documents) GROUP BY 1")
def n19(spark, d):
    role = F.when(F.col("doc_id") % 3 == 0, "chosen").otherwise("text")
    name = F.when(F.col("source").endswith("1"), F.concat(F.lit("Pretrain-"), F.col("source"))).when(F.col("source").endswith("2"), F.concat(F.lit("my-SFT-"), F.col("source"))).otherwise(F.col("source"))
    return table(spark, d, "documents").groupBy(R.rate_role(role, name).alias("role")).agg(F.count("*").alias("n"))


@query("n21_source_groups", "SELECT g AS source_group, count(*) AS n FROM (SELECT CASE WHEN url LIKE '%/en/%' THEN 'code' WHEN url LIKE '%/fr/%' THEN 'wiki' WHEN url LIKE '%/es/%' THEN 'math' ELSE 'other' END AS g FROM pages) GROUP BY g")
def n21(spark, d):
    u = F.col("url")
    name = F.when(u.contains("/en/"), "GitHub-Issues").when(u.contains("/fr/"), "frwiki").when(u.contains("/es/"), "open-math").otherwise("books")
    return table(spark, d, "pages").groupBy(R.source_group(name).alias("source_group")).agg(F.count("*").alias("n"))


@query("q07_poisson_bootstrap")
def q07(spark, d):
    by_doc = documents(spark, d).select("lang", "doc_id", text.tokens(F.col("text")).alias("tokens"), F.regexp_count(F.col("text"), F.lit(",")).cast("long").alias("commas"))
    drawn = stats.resampled(by_doc, ["lang"], "doc_id", ["tokens", "commas"], 100).withColumn("rate", text.rate(F.col("commas"), F.col("tokens")))
    return stats.intervals(drawn, ["lang"], ["rate"])


def _redrawn(spark, d):
    by_doc = documents(spark, d).select("lang", "doc_id", text.tokens(F.col("text")).alias("tokens"), F.regexp_count(F.col("text"), F.lit(",")).cast("long").alias("commas"))
    return bootstrap.redrawn(by_doc.withColumn("documents", F.lit(1)), ["lang"], "doc_id", ["documents", "tokens", "commas"], 100)


@query("q07_draws", "SELECT lang, replicate::INT AS replicate, count(DISTINCT doc_id) AS draws FROM documents, range(100) r(replicate) GROUP BY ALL")
def q07_draws(spark, d):
    """Every replicate draws as many documents as its cell has."""
    return _redrawn(spark, d).select("lang", "replicate", "draws")


@query("q07_fixed_size_bootstrap")
def q07_fixed(spark, d):
    """Intervals of comma rates by language, and the conservative ones of their differences to the first language."""
    drawn = stats.intervals(_redrawn(spark, d).withColumn("rate", text.rate(F.col("commas"), F.col("tokens"))), ["lang"], ["rate"])
    first = drawn.agg(F.min_by(F.struct("rate_low", "rate_high"), "lang").alias("_first"))
    low, high = bootstrap.difference(F.col("rate_low"), F.col("rate_high"), F.col("_first.rate_low"), F.col("_first.rate_high"))
    return drawn.crossJoin(F.broadcast(first)).select("lang", "rate_low", "rate_high", low.alias("delta_low"), high.alias("delta_high"))


@query("q14_edge_scores", "SELECT p_partkey, round(3 * (0.5 + (p_partkey % 7) / 7.0::DOUBLE) * greatest(0, (p_size - 10) / 64.0::DOUBLE) * (0.5 + 0.5 * greatest(-1, least(1, (p_size - 25) / 32.0::DOUBLE))), 9) AS score FROM part")
def q14(spark, d):
    from ..operators.latents import edge_score

    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", F.round(edge_score(F.lit(3), (F.col("p_partkey") % 7) / F.lit(7.0), (s - 10) / F.lit(64.0), (s - 25) / F.lit(32.0)), 9).alias("score"))


@query("s05_benchmark_outputs", "SELECT conv_id, count(*) AS samples FROM conversations GROUP BY conv_id")
def s05(spark, d):
    texts = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("text")).alias("a"))
    shapes = [F.to_json("a"), F.to_json(F.struct(F.col("a").alias("samples"))), F.to_json(F.struct(F.struct(F.col("a").alias("samples")).alias("run")))]
    raw = F.parse_json(F.element_at(F.array(*shapes), (F.col("conv_id") % 3 + 1).cast("int")))
    return texts.select("conv_id", F.size(R.outputs(raw)).cast("long").alias("samples"))


@query("s10_source_weights", "WITH s AS (SELECT c_mktsegment AS source, c_nationkey AS start, count(*) AS w FROM customer GROUP BY ALL) SELECT source, start, w AS weight, lead(start, 1, 26) OVER (PARTITION BY source ORDER BY start) - 1 AS end_step FROM s")
def s10(spark, d):
    from ..operators.spectrum import segment_ends

    segments = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("source"), F.col("c_nationkey").alias("start")).agg(F.count("*").alias("weight"))
    return segment_ends(segments, ["source"], "start", 25)


@query("t05_held_out_by_hash")
def t05(spark, d):
    return sampling.hash_split(table(spark, d, "documents").select("doc_id", "source"), "source", 20.0, 3)


@query("t06_pair_caps", "SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY role ORDER BY sha256(conv_id::VARCHAR || ':' || turn::VARCHAR)) <= 15")
def t06(spark, d):
    h = F.sha2(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")), 256)
    return sampling.per_group(table(spark, d, "conversations"), ["role"], [h], 15).select("conv_id", "turn")


@query("t08_prompt_selection", "SELECT conv_id, turn FROM conversations WHERE role = 'user' ORDER BY sha256('9|' || conv_id::VARCHAR || '|' || turn::VARCHAR || '|' || sha256(text)), conv_id LIMIT 60")
def t08(spark, d):
    key = F.sha2(F.concat_ws("|", F.lit("9"), F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.sha2("text", 256)), 256)
    return table(spark, d, "conversations").where("role = 'user'").orderBy(key, "conv_id").limit(60).select("conv_id", "turn")


@query("t13_batch_top_k", "WITH u AS (SELECT vec_id // 32 AS batch, vec_id, unnest(range(0, len(embedding))) AS i, unnest(embedding) AS v FROM embeddings) SELECT batch, vec_id, i::INT AS i FROM u QUALIFY row_number() OVER (PARTITION BY batch ORDER BY v DESC, vec_id, i) <= 64")
def t13(spark, d):
    u = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 32).alias("batch"), "vec_id", F.posexplode("embedding").alias("i", "v"))
    return sampling.per_group(u, ["batch"], [F.desc("v"), "vec_id", "i"], 64).select("batch", "vec_id", "i")


@query("t14_sampled_prompts", "WITH p AS (SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations) ORDER BY sha256('5|' || conv_id::VARCHAR), conv_id LIMIT 20) SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT conv_id FROM p)")
def t14(spark, d):
    turns = table(spark, d, "conversations")
    chosen = turns.select("conv_id").distinct().orderBy(F.sha2(F.concat_ws("|", F.lit("5"), F.col("conv_id").cast("string")), 256), "conv_id").limit(20)
    return turns.join(chosen, "conv_id", "left_semi").select("conv_id", "turn")


@query("t16_seeded_per_source")
def t16(spark, d):
    return sampling.seeded_shuffle(table(spark, d, "documents"), ["source"], "doc_id", 11, 7).select("source", "doc_id")


@query("u03_metric_families", f"WITH {M.AF} SELECT stage, feature, 'factor' AS family, amplification_factor AS value FROM f UNION ALL SELECT stage, feature, 'rate', reference_rate FROM f UNION ALL SELECT stage, feature, 'mass', mean_prob_mass FROM f")
def u03(spark, d):
    f = M.factors(spark, d)
    out = None
    for family, c in (("factor", "amplification_factor"), ("rate", "reference_rate"), ("mass", "mean_prob_mass")):
        part = f.select("stage", "feature", F.lit(family).alias("family"), F.col(c).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


@query("u06_array_overlap", "WITH s AS (SELECT lang, list_distinct(list(source)) AS a FROM documents GROUP BY lang), t AS (SELECT lang, list_distinct(list(source)) AS b FROM documents JOIN labels USING (doc_id) WHERE quality = 0 GROUP BY lang) SELECT lang, len(list_intersect(a, b)) AS shared, len(list_distinct(list_concat(a, b))) AS together FROM s JOIN t USING (lang)")
def u06(spark, d):
    docs = table(spark, d, "documents")
    poor = docs.join(table(spark, d, "labels").where("quality = 0").select("doc_id"), "doc_id")
    sets = [df.groupBy("lang").agg(F.collect_set("source").alias(n)) for df, n in ((docs, "a"), (poor, "b"))]
    return sets[0].join(sets[1], "lang").select("lang", F.size(F.array_intersect("a", "b")).cast("long").alias("shared"), F.size(F.array_union("a", "b")).cast("long").alias("together"))


@query("u08_compiled_groups", "WITH a AS (SELECT conv_id || '@turn_' || lpad((turn // 2)::VARCHAR, 2, '0') AS base, role, len(text) AS n FROM conversations WHERE role <> 'system') SELECT base, max(n) AS largest FROM a GROUP BY base HAVING count(DISTINCT role) = 2 AND max(n) <= 3000")
def u08(spark, d):
    turns = table(spark, d, "conversations").where("role <> 'system'")
    base = F.concat(F.col("conv_id").cast("string"), F.lit("@turn_"), F.lpad(F.floor(F.col("turn") / 2).cast("string"), 2, "0"))
    human, written = (turns.where(F.col("role") == r).select(base.alias("base"), "role", F.length("text").alias("n")) for r in ("user", "assistant"))
    return joins.complete_groups(human.unionByName(written), "base", "role", ["user", "assistant"], "n", 3000)


@query("w03_token_windows", f"SELECT doc_id, ceil(greatest({TOKENS}, 1) / 32.0::DOUBLE)::BIGINT AS windows FROM documents")
def w03(spark, d):
    return table(spark, d, "documents").select("doc_id", F.ceil(F.greatest(text.tokens(F.col("text")), F.lit(1)) / F.lit(32.0)).alias("windows"))


@query("w07_head_per_group", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def w07(spark, d):
    return sampling.per_group(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey")


@query("w10_ranked_rows", "SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_nationkey, s_suppkey) AS rank FROM supplier")
def w10(spark, d):
    return sampling.top(table(spark, d, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey"), [F.desc("s_acctbal"), F.col("s_nationkey"), F.col("s_suppkey")], 0).select("s_suppkey", "rank")


@query("x29_estimated_jaccard")
def x29(spark, d):
    s = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", spans.minhash_function(16)(F.col("text")).alias("s"))
    first = s.groupBy("conv_id").agg(F.min_by("s", "turn").alias("f"))
    return s.join(first, "conv_id").select("conv_id", "turn", spans.estimated_jaccard(F.col("s"), F.col("f")).alias("similarity"))


@query("x42_progress_times", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS started, (event_id % 90)::INT AS minutes FROM events")
def x42(spark, d):
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" step ["), (F.col("event_id") % 90).cast("string"), F.lit("m elapsed]"))
    return table(spark, d, "events").select("event_id", line.alias("l")).select("event_id", F.date_format(F.to_timestamp(F.regexp_extract("l", r"^(\S+ \S+)", 1)), "yyyy-MM-dd HH:mm:ss").alias("started"), F.regexp_extract("l", r"\[(\d+)m", 1).cast("int").alias("minutes"))


@query("g01_propensity_contract")
def g01(spark, d):
    """Opportunities of whole documents, scored by a language model of the same documents and carried through to factors."""
    features = ("neutral_common_of_the", "neutral_common_in_the")
    o = documents(spark, d).select("source", "text", spans.opportunity_function(features)(F.col("text")).alias("o"))
    scored = lm.counted_masses(lm.fit(table(spark, d, "documents")), o, "o", ["source"], {f: P.opportunity_specs()[f][1] for f in features})
    out = rates.amplification(scored, ["source"], "neutral_common_in_the", "opportunities")
    return out.select("source", "feature", "opportunities", "reference_initiations", *(F.round(c, 9).alias(c) for c in ("reference_rate", "mean_prob_mass", "amplification_factor", "normalized_amplification_factor")))


_GRAMS = rf"""WITH d AS (SELECT ['<s>', '<s>'] || list_transform(regexp_extract_all(coalesce(text, ''), '{lm.TOKEN}'), lambda x: lower(x)) || ['</s>'] AS t FROM documents),
    g AS (SELECT t, unnest(range(1, len(t) - 1)) AS i FROM d),
    three AS (SELECT t[i] AS u, t[i + 1] AS v, t[i + 2] AS w, count(*) AS c FROM g GROUP BY ALL),
    two AS (SELECT v, w, count(*) AS c FROM three GROUP BY ALL), one AS (SELECT w, count(*) AS c FROM two GROUP BY ALL)"""
_D = "(SELECT CASE WHEN count(*) FILTER (WHERE c = 1) > 0 AND count(*) FILTER (WHERE c = 2) > 0 THEN count(*) FILTER (WHERE c = 1) / (count(*) FILTER (WHERE c = 1) + 2.0 * count(*) FILTER (WHERE c = 2)) ELSE 0.75 END FROM {0})"
_PROBABILITIES = f"""{_GRAMS}, k AS (SELECT {_D.format("three")} AS d3, {_D.format("two")} AS d2, {_D.format("one")} AS d1, (SELECT sum(c) FROM one) AS n, (SELECT count(*) FROM one) AS types),
    p1 AS (SELECT w, (greatest(c - d1, 0) + d1 * types / (types + 1.0)) / n AS p FROM one, k),
    p2 AS (SELECT v, w, (greatest(c - d2, 0) + d2 * count(*) OVER x * p) / sum(c) OVER x AS p FROM two JOIN p1 USING (w), k WINDOW x AS (PARTITION BY v))
    SELECT u, v, w, c, round((greatest(c - d3, 0) + d3 * count(*) OVER x * p) / sum(c) OVER x, 9) AS p FROM three JOIN p2 USING (v, w), k WINDOW x AS (PARTITION BY u, v)"""


@query("g01_ngram_probabilities", _PROBABILITIES)
def g01_probabilities(spark, d):
    """Every trigram of the documents with its smoothed probability."""
    return lm.seen(lm.fit(table(spark, d, "documents"))).select("u", "v", "w", "c", F.round("p", 9).alias("p"))


def _searched(spark, d):
    """Each different turn as a prompt, followers under a model of all turns, and a detector of quality learned from all labelled documents."""
    turns = table(spark, d, "conversations").where(F.col("text").isNotNull())
    prompts = turns.groupBy("text").agg(F.count("*").alias("turns")).withColumn("prompt", F.sha2("text", 256))
    labelled = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return prompts, beam.followers(lm.fit(turns), 16), beam.bucket_detector(labelled, "text", "quality", 2)


@query("g09_beam_search")
def g09(spark, d):
    """The last beams of a search of eight words after every turn of the conversations."""
    prompts, known, detector = _searched(spark, d)
    found = beam.last_beams(beam.search(prompts, "prompt", "text", known, detector, 8, quality=0.1), "prompt")
    return found.join(prompts.select("prompt", "turns"), "prompt").select("prompt", "turns", "beam_rank", F.array_join("words", " ").alias("continuation"), *(F.round(c, 6).alias(c) for c in ("log_p", "score", "objective")))


@query("g02_sampled_continuations")
def g02(spark, d):
    """Two seeded samples of eight words after every turn, with the detector's score."""
    prompts, known, detector = _searched(spark, d)
    found = beam.sampled(prompts, "prompt", "text", known, detector, 8, samples=2)
    return found.select("prompt", "sample", F.array_join("words", " ").alias("continuation"), *(F.round(c, 6).alias(c) for c in ("log_p", "score")))


_SPANS = ", ".join(f"{{'length': {n}, 'score': CASE WHEN c >= {n} THEN {' + '.join(['score'] + [f'lead(score, {k}) OVER w' for k in range(1, n)])} END}}" for n in range(1, 5))


@query("g05_span_scores", f"WITH t AS (SELECT doc_id, unnest(range(0, len(string_split(text, ' ')))) AS i FROM documents), s AS (SELECT doc_id, i, (i % 4)::DOUBLE AS score, count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS c FROM t), u AS (SELECT doc_id, i, unnest([{_SPANS}]) AS x FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY i)) SELECT doc_id, i::INT AS start, x.length AS length, round(x.score / sqrt(x.length::DOUBLE), 9) AS score FROM u WHERE x.score IS NOT NULL")
def g05(spark, d):
    """All spans of whole documents. Texts move by document before they become tokens, so that the spans need no shuffle of tokens."""
    docs = table(spark, d, "documents").select("doc_id", "text").repartition("doc_id")
    t = docs.select("doc_id", F.posexplode(F.split("text", " ")).alias("token_index", "token")).withColumn("score", (F.col("token_index") % 4).cast("double"))
    return provider.span_scores(t).select("doc_id", "start", "length", F.round("score", 9).alias("score"))


@query("x16_union_of_intervals", """WITH l AS (SELECT l_suppkey, l_shipdate::DATE - DATE '1970-01-01' AS low, l_shipdate::DATE - DATE '1970-01-01' + l_quantity::BIGINT AS high FROM lineitem),
    r AS (SELECT *, max(high) OVER (PARTITION BY l_suppkey ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM l),
    b AS (SELECT *, sum(CASE WHEN reach IS NULL OR low > reach THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS block FROM r)
    SELECT l_suppkey, min(low)::INT AS low, max(high)::INT AS high, count(*) AS n FROM b GROUP BY l_suppkey, block""")
def x16_union(spark, d):
    """Days in which each supplier has something under way, a day for each piece from shipping on, as blocks without gaps."""
    low = F.unix_date(F.col("l_shipdate").cast("date"))
    rows = table(spark, d, "lineitem").select("l_suppkey", low.alias("low"), (low + F.col("l_quantity").cast("int")).alias("high"))
    return intervals.union(rows, ["l_suppkey"], "low", "high")


@query("x16_contrast_blocks")
def x16(spark, d):
    """Blocks of sentences with contrasts in whole documents; without a tagger the surface forms count."""
    return intervals.contrast_blocks(documents(spark, d), "doc_id", "text")


@query("x33_quality_penalty")
def x33(spark, d):
    return documents(spark, d).select("doc_id", F.round(text.quality_penalty(F.col("text")), 9).alias("penalty"))


@query("s04_loaded_records", "SELECT conv_id::VARCHAR || ':' || turn::VARCHAR AS record_id, trim(text, E' \\t\\n\\r') AS text FROM conversations WHERE trim(text, E' \\t\\n\\r') <> ''")
def s04(spark, d):
    """Payloads that name their text and id differently, loaded to one shape."""
    i = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    shapes = [F.to_json(F.struct(i.alias("id"), F.col("text"))), F.to_json(F.struct(i.alias("doc_id"), F.col("text").alias("content"))), F.to_json(F.struct(i.alias("uid"), F.col("text").alias("response")))]
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_index"), F.parse_json(F.element_at(F.array(*shapes), (F.col("turn") % 3 + 1).cast("int"))).alias("raw"))
    return R.records(rows, "loaded").select("record_id", "text")


@query("s07_pruned_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01'")
def s07(spark, d):
    return table(spark, d, "lineitem").where(F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp")).select("l_orderkey", "l_quantity")


@query("o04_next_shards", "WITH p AS (SELECT n_regionkey AS stage, n_nationkey AS shard, count(s_suppkey) AS done FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL) SELECT stage, min(shard) AS shard FROM p WHERE done < 4 GROUP BY stage")
def o04(spark, d):
    """The first shard of each stage that is not complete."""
    found = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("shard")).agg(F.count("*").alias("done"))
    plan = table(spark, d, "nation").select(F.col("n_regionkey").alias("stage"), F.col("n_nationkey").alias("shard")).join(found, "shard", "left")
    return plan.where(F.coalesce("done", F.lit(0)) < 4).groupBy("stage").agg(F.min("shard").alias("shard"))


@query("o07_phrase_audit", "SELECT source, bool_or(contains(text, 'GNU General Public License')) AS has_required, count(*) FILTER (WHERE regexp_matches(text, '!!')) AS forbidden FROM documents GROUP BY source")
def o07(spark, d):
    """Required and forbidden phrases by group: the table-shaped core of text audits."""
    return table(spark, d, "documents").groupBy("source").agg(F.bool_or(F.col("text").contains("GNU General Public License")).alias("has_required"), F.count_if(F.col("text").rlike("!!")).alias("forbidden"))


@query("q16_gates", "WITH c AS (SELECT p_brand, count(*) AS n, count(*) FILTER (WHERE p_size > 25) AS k FROM part GROUP BY 1) SELECT p_brand, CASE WHEN k::DOUBLE / n >= 0.5 THEN 'pass' ELSE 'demote' END AS gate FROM c")
def q16(spark, d):
    c = table(spark, d, "part").groupBy("p_brand").agg((F.count_if(F.col("p_size") > 25) / F.count("*")).alias("share"))
    return c.select("p_brand", F.when(F.col("share") >= 0.5, "pass").otherwise("demote").alias("gate"))


@query("q15_density_clusters")
def q15(spark, d):
    """Clusters of all embeddings at unit length, noise as -1."""
    found = density.clusters(table(spark, d, "embeddings"), "vec_id", "embedding", min_samples=5, min_cluster_size=10, levels=6)
    return found.select(F.col("item").alias("vec_id"), "cluster")


@query("g04_text_classifier")
def g04_classifier(spark, d):
    """Quality of all documents, learned from the labelled ones outside a fold."""
    docs, labels = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "labels").select("doc_id", "quality")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = classifier.train_classifier(docs.join(labels, "doc_id").where(~held_out), "doc_id", "text", "quality", rounds=25)
    return model.scored(docs, "doc_id", "text").select("doc_id", held_out.alias("held_out"), (1.0 / (1.0 + F.exp(-F.col("score")))).alias("probability"))


@query("g04_pair_ranker")
def g04_ranker(spark, d):
    """Turns of the assistant ranked above the first turn of the user in each conversation, and how often that succeeds."""
    turns = table(spark, d, "conversations").select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("item"), "text", (F.col("role") == "assistant").alias("higher"))
    scored = classifier.train_ranker(turns, "item", "text", "conv_id", "higher", rounds=25).scored(turns, "item", "text")
    # The user's first turn is the one that others are held against.
    first = turns.where(~F.col("higher")).groupBy("conv_id").agg(F.min("item").alias("item")).withColumn("human", F.lit(True))
    sides = turns.join(scored, "item").join(first, ["conv_id", "item"], "left").where("higher OR human")
    return annotation.pairwise_ranking(sides.select("conv_id", "score", F.coalesce("human", F.lit(False)).alias("human")), "conv_id")
