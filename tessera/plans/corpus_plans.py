"""Censuses, records, filters, samples and sets over documents and conversations (A1, A2, N, F, S, T, U, W)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns as P
from ..functions import spans, text
from ..operators import joins, rates, sampling, style
from ..sources import records as R
from ..sources import sinks
from .base import PLAIN, TOKENS, documents, query, sql_count, table



def _census_features():
    out = text.items(F.col("text"), P.neutral("common"))
    for family in ("stock_lexicon", "candidate_lexicon", "punctuation"):
        out[family] = text.total(list(text.items(F.col("text"), P.FAMILIES[family]).values()))
    return out


_CENSUS_SQL = {n: sql_count(p) for n, p in P.neutral("common").items()} | {f: "(" + " + ".join(sql_count(p, "text" if f == "punctuation" else "plain") for p in P.FAMILIES[f].values()) + ")" for f in ("stock_lexicon", "candidate_lexicon", "punctuation")}
_CENSUS_FROM = "WITH f AS (SELECT source, lang, tokens, unnest([" + ", ".join(f"{{'feature': '{n}', 'n': {c}}}" for n, c in _CENSUS_SQL.items()) + f"]) AS u FROM (SELECT source, lang, text, {TOKENS} AS tokens, {PLAIN} AS plain FROM documents)), c AS (SELECT source, lang, u.feature AS feature, sum(u.n)::DOUBLE AS count, count(*) AS docs, sum(tokens)::BIGINT AS tokens FROM f GROUP BY ALL)"


def census(spark, d):
    return rates.census(documents(spark, d), ["source", "lang"], text.tokens(F.col("text")), _census_features())


@query("a01_census", _CENSUS_FROM + " SELECT source, lang, feature, count, docs, tokens, count * 1000.0::DOUBLE / greatest(tokens, 1) AS per_1k_tokens, count / greatest(docs, 1) AS per_doc FROM c")
def a01(spark, d):
    return census(spark, d)


@query("a02_regrouped_census", _CENSUS_FROM + ", g AS (SELECT source, feature, lang, grouping(lang) AS g, sum(count) AS count, sum(docs)::BIGINT AS docs, sum(tokens)::BIGINT AS tokens FROM c GROUP BY GROUPING SETS ((source, feature), (source, feature, lang))) SELECT source, feature, lang, CASE WHEN g = 1 THEN 'corpus' ELSE 'stratum' END AS level, count, docs, tokens, count * 1000.0::DOUBLE / greatest(tokens, 1) AS per_1k_tokens, count / greatest(docs, 1) AS per_doc FROM g")
def a02(spark, d):
    return rates.regroup(census(spark, d), ["source"], "lang")


@query("a10_pooled_rates", _CENSUS_FROM + " SELECT feature, sum(count) AS count, sum(tokens)::BIGINT AS tokens, sum(count) * 1000.0::DOUBLE / greatest(sum(tokens), 1) AS pooled_per_1k FROM c GROUP BY feature")
def a10(spark, d):
    return rates.pooled(census(spark, d), ["feature"])


@query("a18_pattern_census", f"SELECT source, pattern, docs, tokens, hits, docs_with_hit, hits::DOUBLE * 1000.0::DOUBLE / greatest(tokens, 1) AS per_1k_tokens, docs_with_hit::DOUBLE / greatest(docs, 1) AS doc_prevalence FROM (SELECT source, u.p AS pattern, count(*) AS docs, sum(tokens)::BIGINT AS tokens, sum(u.n)::BIGINT AS hits, count(*) FILTER (WHERE u.n > 0) AS docs_with_hit FROM (SELECT source, tokens, unnest([{{'p': 'shout', 'n': len(regexp_extract_all(text, '!!'))}}, {{'p': 'pipe', 'n': len(regexp_extract_all(text, '\\|'))}}]) AS u FROM (SELECT source, text, {TOKENS} AS tokens FROM documents)) GROUP BY ALL)")
def a18(spark, d):
    return style.pattern_census(documents(spark, d), ["source"], F.col("text"), text.tokens(F.col("text")), {"shout": "!!", "pipe": r"\|"})


_W = "list_filter(string_split(lower(text), ' '), lambda t: regexp_full_match(t, '[a-z]+'))"
_SIDE = "CASE WHEN doc_id % 2 = 0 THEN 'model' ELSE 'reference' END"
_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_EDGE = ", ".join(f"'{w}'" for w in text.EDGE_WORDS)
_GRAMS = f"""WITH w AS (SELECT doc_id, {_SIDE} AS side, {_W} AS w FROM documents WHERE lang = 'en'),
g AS (SELECT doc_id, side, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS phrase FROM w),
k AS (SELECT * FROM g WHERE CASE WHEN position(' ' IN phrase) = 0 THEN phrase NOT IN ({_STOP}) AND len(phrase) >= 3
  ELSE split_part(phrase, ' ', 1) NOT IN ({_EDGE}) AND split_part(phrase, ' ', 2) NOT IN ({_EDGE}) AND NOT (split_part(phrase, ' ', 1) IN ({_STOP}) AND split_part(phrase, ' ', 2) IN ({_STOP})) END),
c AS (SELECT side, phrase, count(*) AS count, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_doc FROM k GROUP BY ALL)"""


def _english(spark, d):
    w = F.filter(F.split(F.lower("text"), " "), lambda t: t.rlike("^[a-z]+$"))
    side = F.when(F.col("doc_id") % 2 == 0, "model").otherwise("reference")
    return documents(spark, d).where("lang = 'en'").select("doc_id", side.alias("side"), w.alias("w"))


@query("a15_ngram_counts", _GRAMS + " SELECT side, phrase, count, docs, first_doc FROM c WHERE count >= 5")
def a15(spark, d):
    return style.corpus_counts(_english(spark, d), "side", "doc_id", F.col("w"), (1, 2), 1).where("count >= 5")


@query("a16_lift", _GRAMS + """, t AS (SELECT side, sum(len(w))::BIGINT AS tokens, count(*) AS docs FROM w GROUP BY side),
j AS (SELECT phrase, coalesce(max(count) FILTER (WHERE side = 'model'), 0) AS mc, coalesce(max(docs) FILTER (WHERE side = 'model'), 0) AS md, coalesce(max(count) FILTER (WHERE side = 'reference'), 0) AS rc FROM c GROUP BY phrase),
x AS (SELECT phrase, mc, md, rc, (SELECT tokens FROM t WHERE side = 'model') AS mt, (SELECT tokens FROM t WHERE side = 'reference') AS rt, (SELECT docs FROM t WHERE side = 'model') AS mdocs, (SELECT count(*) FROM j) AS v FROM j),
l AS (SELECT *, ((mc + 0.5::DOUBLE) / (mt + 0.5::DOUBLE * v)) / ((rc + 0.5::DOUBLE) / (rt + 0.5::DOUBLE * v)) AS lift FROM x)
SELECT phrase, mc AS model_count, rc AS reference_count, round(lift, 6) AS lift, round(log2(lift) * sqrt(md) * (1 + md::DOUBLE / mdocs), 6) AS score FROM l WHERE mc >= 3 AND md >= 2 AND lift >= 1.5""")
def a16(spark, d):
    docs = _english(spark, d)
    counts = style.corpus_counts(docs, "side", "doc_id", F.col("w"), (1, 2), 1)
    totals = docs.groupBy("side").agg(F.sum(F.size("w")).alias("tokens"), F.count("*").alias("docs"))
    return style.lift(counts, totals, "side", "model", "reference", 3, 2, 1.5).select("phrase", "model_count", "reference_count", F.round("lift", 6).alias("lift"), F.round("score", 6).alias("score"))


@query("w08_representatives", _GRAMS + ", m AS (SELECT left(phrase, 2) AS cluster, phrase, count FROM c WHERE side = 'model') SELECT cluster, phrase, count FROM m QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY (position(' ' IN phrase) > 0) DESC, count DESC, phrase) = 1")
def w08(spark, d):
    counts = style.corpus_counts(_english(spark, d), "side", "doc_id", F.col("w"), (1, 2), 1).where("side = 'model'")
    return sampling.representative(counts.withColumn("cluster", F.left("phrase", F.lit(2))), "cluster", "phrase", "count").select("cluster", "phrase", "count")


@query("a17_cluster_rollup", "WITH n AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS r FROM n) SELECT lang, sum(n)::BIGINT AS n, max(source) FILTER (WHERE r = 1) AS top, string_agg(source, ';' ORDER BY r) FILTER (WHERE r <= 6) AS top_items FROM r GROUP BY lang")
def a17(spark, d):
    return rates.top_items(table(spark, d, "documents"), ["lang"], "source", 6)


@query("a31_row_counts", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def a31(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("a34_length_percentiles", "SELECT lang, quantile_cont(n_chars, 0.5)::BIGINT AS p50, quantile_cont(n_chars, 0.9)::BIGINT AS p90, max(n_chars) AS longest FROM (SELECT lang, n_chars::DOUBLE AS n_chars FROM documents) GROUP BY lang".replace("quantile_cont(n_chars, 0.5)::BIGINT", "floor(quantile_cont(n_chars, 0.5))::BIGINT").replace("quantile_cont(n_chars, 0.9)::BIGINT", "floor(round(quantile_cont(n_chars, 0.9), 6))::BIGINT"))
def a34(spark, d):
    p = F.percentile(F.col("n_chars").cast("double"), F.array(F.lit(0.5), F.lit(0.9)))
    return table(spark, d, "documents").groupBy("lang").agg(p.alias("p"), F.max(F.col("n_chars").cast("double")).alias("longest")).select("lang", F.floor(F.element_at("p", 1)).alias("p50"), F.floor(F.round(F.element_at("p", 2), 6)).alias("p90"), "longest")


@query("a12_source_shares", "SELECT source, sum(n_chars)::BIGINT AS chars, round(sum(n_chars)::DOUBLE / sum(sum(n_chars)) OVER (), 9) AS share, string_agg(DISTINCT lang, ';' ORDER BY lang) AS langs FROM documents GROUP BY source")
def a12(spark, d):
    g = table(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").alias("chars"), F.array_join(F.array_sort(F.collect_set("lang")), ";").alias("langs"))
    return g.withColumn("share", F.round(F.col("chars") / F.sum("chars").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), 9))


# Records


def _turn_rows(spark, d):
    """Conversations as raw chat rows of a variant column: one row for each conversation."""
    turns = table(spark, d, "conversations")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    chats = turns.groupBy("conv_id").agg(ordered.alias("messages"))
    raw = F.parse_json(F.to_json(F.struct(F.col("conv_id").cast("string").alias("id"), "messages", F.lit("chat-web").alias("domain"))))
    return chats.select(F.col("conv_id").alias("row_index"), raw.alias("raw"))


_TRIM = "nullif(trim(text, E' \\t\\n\\r'), '')"
_CHAT = f"SELECT conv_id, string_agg({_TRIM}, E'\\n' ORDER BY turn) FILTER (WHERE role IN ('user', 'system')) AS prompt, string_agg({_TRIM}, E'\\n' ORDER BY turn) FILTER (WHERE role = 'assistant') AS answer, string_agg({_TRIM}, E'\\n' ORDER BY turn) AS everything, bool_or(role = 'assistant') AS has_answer, bool_or(role IN ('user', 'system')) AS has_prompt FROM conversations GROUP BY conv_id"


@query("n03_records", f"SELECT conv_id AS row_index, conv_id::VARCHAR AS record_id, CASE WHEN has_prompt THEN prompt ELSE everything END AS prompt, coalesce(CASE WHEN has_answer THEN answer ELSE everything END, prompt) AS text, 'web_cc' AS inferred_stratum FROM ({_CHAT}) WHERE coalesce(CASE WHEN has_answer THEN answer ELSE everything END, prompt) IS NOT NULL")
def n03(spark, d):
    return R.records(_turn_rows(spark, d), "chats").select("row_index", "record_id", "prompt", "text", "inferred_stratum")


@query("n01_first_text", f"SELECT conv_id AS row_index, CASE WHEN has_answer THEN answer ELSE everything END AS found, CASE WHEN (CASE WHEN has_answer THEN answer ELSE everything END) IS NOT NULL THEN 'messages' END AS field FROM ({_CHAT})")
def n01(spark, d):
    found, field = R.first_text(F.col("raw"), P.TEXT_FIELDS, ("assistant",))
    return _turn_rows(spark, d).select("row_index", found.alias("found"), field.alias("field"))


@query("n06_metadata", "SELECT event_id AS row_index, event_type AS domain, props->>'page' IS NOT NULL AS has_page, len(json_keys(props)) AS members FROM events")
def n06(spark, d):
    raw = F.parse_json(F.to_json(F.struct(F.col("event_type").alias("domain"), F.col("props").alias("metadata"))))
    m = R.metadata(raw)
    return table(spark, d, "events").select(F.col("event_id").alias("row_index"), m.alias("m")).select("row_index", F.col("m")["domain"].alias("domain"), F.col("m")["metadata.page"].isNotNull().alias("has_page"), (F.size("m") - 1).cast("long").alias("members"))


@query("n07_stratum", "SELECT s AS stratum, count(*) AS n FROM (SELECT CASE WHEN url LIKE '%/en/%' THEN 'code' WHEN url LIKE '%/fr/%' THEN 'wiki' ELSE 'web_cc' END AS s FROM pages) GROUP BY s")
def n07(spark, d):
    mark = F.when(F.col("url").contains("/en/"), "github").when(F.col("url").contains("/fr/"), "wikipedia").otherwise("cc-main")
    return table(spark, d, "pages").groupBy(R.stratum(F.create_map(F.lit("source"), mark)).alias("stratum")).agg(F.count("*").alias("n"))


@query("n08_subset", "SELECT coalesce(CASE WHEN doc_id % 3 = 0 THEN lang END, CASE WHEN doc_id % 3 = 1 THEN source END, 'default') AS subset, count(*) AS n FROM documents GROUP BY 1")
def n08(spark, d):
    i = F.col("doc_id") % 3
    m = F.create_map(F.lit("stratum"), F.when(i == 0, F.col("lang")).otherwise(""), F.lit("source"), F.when(i == 1, F.col("source")))
    return table(spark, d, "documents").groupBy(R.subset(m, F.lit(None).cast("string")).alias("subset")).agg(F.count("*").alias("n"))


@query("n09_measured_roles", "SELECT role, count(*) AS n, sum(len(text))::BIGINT AS chars, count(pair_id) AS paired FROM (SELECT unnest(CASE WHEN doc_id % 2 = 0 THEN [{'role': 'chosen', 'text': text, 'pair_id': doc_id::VARCHAR}, {'role': 'rejected', 'text': reverse(text), 'pair_id': doc_id::VARCHAR}] ELSE [{'role': 'text', 'text': text, 'pair_id': NULL}] END, recursive := true) FROM documents) GROUP BY role")
def n09(spark, d):
    even = F.col("doc_id") % 2 == 0
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("record_id"), F.when(even, F.col("text")).alias("chosen"), F.when(even, F.reverse(F.col("text"))).alias("rejected"), "text")
    return R.measured(rows).groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.count("pair_id").alias("paired"))


@query("n11_enriched", rf"SELECT doc_id::VARCHAR AS doc_id, sha256(text) AS content_hash, {TOKENS} AS token_count, greatest(1, len(regexp_extract_all(text, '[.!?]+(?:\s+|$)'))) AS sentence_count FROM documents")
def n11(spark, d):
    rows = documents(spark, d).select(F.col("doc_id").cast("string").alias("record_id"), F.lit("text").alias("role"), F.lit(None).cast("string").alias("pair_id"), "text")
    return R.enriched(rows).select("doc_id", "content_hash", "token_count", "sentence_count")


@query("n13_buckets", "SELECT CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'romance' WHEN 'es' THEN 'romance' ELSE 'rest' END AS bucket, count(*) AS n FROM documents GROUP BY 1")
def n13(spark, d):
    b = R.bucketed(F.create_map(F.lit("lang"), F.col("lang")), ["missing", "lang"], {"en": "english", "fr": "romance", "es": "romance"}, "rest")
    return table(spark, d, "documents").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


@query("n14_predicates", "SELECT count(*) FILTER (WHERE lang = 'en') AS equal_rows, count(*) FILTER (WHERE lang IS DISTINCT FROM 'en') AS unequal_rows FROM documents")
def n14(spark, d):
    return table(spark, d, "documents").agg(F.count_if(R.predicate("lang=en", F.col("lang"))).alias("equal_rows"), F.count_if(R.predicate("lang!=en", F.col("lang"))).alias("unequal_rows"))


@query("n15_assistant_turns", "SELECT conv_id, turn, o::BIGINT AS ordinal, before AS input_messages, left(sha256(conv_id::VARCHAR || '|' || turn::VARCHAR || '|' || text), 12) AS turn_id, len(text) AS chars FROM (SELECT *, sum((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS o, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS before FROM conversations) WHERE role = 'assistant'")
def n15(spark, d):
    return R.assistant_turns(table(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", "ordinal", F.size("input").alias("input_messages"), "turn_id", "chars")


@query("n16_rendered", "SELECT conv_id, md5(CASE WHEN count(*) = 1 AND min(role) = 'user' THEN min(text) ELSE string_agg(upper(role) || E':\\n' || text, E'\\n\\n' ORDER BY turn) END) AS prompt FROM conversations GROUP BY conv_id")
def n16(spark, d):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(ordered.alias("m")).select("conv_id", F.md5(R.rendered(F.col("m"))).alias("prompt"))


@query("n17_authors", "SELECT base, author, count(*) AS n FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN source ELSE source END AS base, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'chunk_2' END AS author FROM documents) GROUP BY ALL")
def n17(spark, d):
    composite = F.when(F.col("doc_id") % 2 == 0, F.concat_ws("@", "source", "lang")).otherwise(F.concat("source", F.lit("_chunk_2")))
    base, who = R.author(composite)
    return table(spark, d, "documents").groupBy(base.alias("base"), who.alias("author")).agg(F.count("*").alias("n"))


@query("n18_canonical", "SELECT CASE lang WHEN 'fr' THEN 'french' ELSE lang END AS name, count(*) AS n FROM documents GROUP BY 1")
def n18(spark, d):
    return table(spark, d, "documents").groupBy(R.canonical(F.col("lang"), {"fr": "french"}).alias("name")).agg(F.count("*").alias("n"))


@query("n20_safe_names", "SELECT p_partkey, trim(regexp_replace(lower(p_type || ' / ' || p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS name FROM part")
def n20(spark, d):
    return table(spark, d, "part").select("p_partkey", R.safe_name(F.concat("p_type", F.lit(" / "), "p_brand")).alias("name"))


@query("n22_redacted", "SELECT doc_id, lang, source, n_chars, len(text) AS text_chars FROM documents")
def n22(spark, d):
    return R.redacted(table(spark, d, "documents"), ["text"])


@query("n23_qualified_ids", "SELECT CASE WHEN count(*) OVER (PARTITION BY source) > 60 OR count(*) OVER (PARTITION BY md5(text)) > 1 THEN md5(text) || '#row' || doc_id ELSE md5(text) END AS id FROM documents".replace("count(*) OVER (PARTITION BY source) > 60 OR ", ""))
def n23(spark, d):
    return R.qualified(table(spark, d, "documents").select(F.md5("text").alias("id"), "doc_id"), "id", "doc_id").select("id")


# Filters, samples, sets, windows


@query("f01_strata", "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'fr') AND source NOT IN ('src1')")
def f01(spark, d):
    return table(spark, d, "documents").where(F.col("lang").isin("en", "fr") & ~F.col("source").isin("src1")).select("doc_id", "lang")


@query("f02_english", "SELECT doc_id FROM documents WHERE lang = 'en'")
def f02(spark, d):
    return table(spark, d, "documents").where(R.english(F.col("lang"), F.col("text"))).select("doc_id")


@query("f05_longer_than", "SELECT doc_id FROM documents WHERE len(text) > 2000")
def f05(spark, d):
    return table(spark, d, "documents").where(F.length("text") > 2000).select("doc_id")


@query("f09_word_range", r"SELECT doc_id FROM (SELECT doc_id, lang, text, len(list_filter(string_split_regex(text, '\s+'), lambda t: t <> '')) AS w FROM documents) WHERE w BETWEEN 50 AND 200 AND lang IN ('en', 'de') AND contains(text, 'the') AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def f09(spark, d):
    docs = table(spark, d, "documents").where(text.words(F.col("text")).between(50, 200) & F.col("lang").isin("en", "de") & (F.regexp_count(F.col("text"), F.lit("the")) > 0))
    return docs.join(table(spark, d, "labels").where("quality = 0"), "doc_id", "left_anti").select("doc_id")


@query("f11_complete_groups", "SELECT source, max(n_chars) AS largest FROM documents GROUP BY source HAVING count(DISTINCT lang) FILTER (WHERE lang IN ('en', 'fr', 'de')) = 3 AND max(n_chars) <= 12000")
def f11(spark, d):
    return joins.complete_groups(table(spark, d, "documents"), "source", "lang", ["en", "fr", "de"], "n_chars", 12000)


@query("t01_first_rows", "SELECT doc_id FROM documents WHERE doc_id < 100")
def t01(spark, d):
    return sampling.first_rows(table(spark, d, "documents"), "doc_id", 300, 100).select("doc_id")


_KEY = "left(sha256('7|docs|train|' || doc_id::VARCHAR), 16)"


@query("t02_hash_reservoir", f"SELECT doc_id, {_KEY} AS sample_key FROM documents ORDER BY sample_key, doc_id DESC LIMIT 50")
def t02(spark, d):
    return sampling.hash_reservoir(table(spark, d, "documents"), sampling.sample_key("sha256", 7, "docs", "train", F.col("doc_id")), 50, "doc_id").select("doc_id", "sample_key")


@query("t03_sampling_keys")
def t03(spark, d):
    return table(spark, d, "documents").select("doc_id", sampling.sample_key("blake2b", 13, "docs", "train", F.col("doc_id")).alias("sample_key"))


@query("t04_per_stratum", f"SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {_KEY}, doc_id DESC) <= 20")
def t04(spark, d):
    keyed = table(spark, d, "documents").withColumn("key", sampling.sample_key("sha256", 7, "docs", "train", F.col("doc_id")))
    return sampling.per_stratum(keyed, "lang", "key", "doc_id", 20, 30, "hash").select("doc_id", "lang")


@query("t07_blinded", "SELECT item_id, 'blind_' || lpad(row_number() OVER (ORDER BY sha256('3|' || item_id::VARCHAR), item_id)::VARCHAR, 4, '0') AS blind_id FROM benchmark")
def t07(spark, d):
    return sampling.blinded(table(spark, d, "benchmark").select("item_id"), ["item_id"], 3)


def _prompts(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("item"), "text")


@query("j08_near_duplicate_edges")
def j08(spark, d):
    """Prompts and, as their near copies, the same ones with a word more."""
    prompts = _prompts(spark, d)
    again = prompts.select((F.col("item") + 500).alias("item"), F.concat("text", F.lit(" again")).alias("text"))
    return sampling.near_duplicate_edges(prompts.unionByName(again), "item", "text")


@query("t09_near_duplicates_removed")
def t09(spark, d):
    """Documents that stay when, by id, each near copy of one that stays goes."""
    return sampling.without_near_duplicates(documents(spark, d), "doc_id", "text", "doc_id").select("doc_id")


@query("t10_top_candidates", "SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part QUALIFY rank <= 25")
def t10(spark, d):
    return sampling.top(table(spark, d, "part").select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), F.col("p_partkey")], 25)


@query("w05_top_per_group", f"SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {_KEY}, doc_id) <= 5")
def w05(spark, d):
    keyed = table(spark, d, "documents").withColumn("key", sampling.sample_key("sha256", 7, "docs", "train", F.col("doc_id")))
    return sampling.per_group(keyed, ["source"], ["key", "doc_id"], 5).select("doc_id", "source")


@query("w09_keep_last", "SELECT source, lang, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) = 1")
def w09(spark, d):
    from ..operators.spectrum import last_written

    return last_written(table(spark, d, "documents").select("source", "lang", "doc_id", "n_chars"), ["source", "lang"], "doc_id")


@query("w12_segment_ends", "SELECT conv_id, turn AS start, lead(turn, 1, 101) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS end_step FROM conversations")
def w12(spark, d):
    from ..operators.spectrum import segment_ends

    return segment_ends(table(spark, d, "conversations").select("conv_id", F.col("turn").alias("start")), ["conv_id"], "start", 100)


@query("u01_union_tagged", "SELECT 'documents' AS input, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages")
def u01(spark, d):
    a = table(spark, d, "documents").select(F.lit("documents").alias("input"))
    return a.unionByName(table(spark, d, "pages").select(F.lit("pages").alias("input"))).groupBy("input").agg(F.count("*").alias("n"))


@query("u02_union_last", "SELECT doc_id, coalesce(l.quality, 9) AS quality FROM documents d LEFT JOIN (SELECT doc_id, quality FROM labels) l USING (doc_id)")
def u02(spark, d):
    old = table(spark, d, "documents").select("doc_id", F.lit(9).alias("quality"))
    return joins.union_last(old, table(spark, d, "labels").select("doc_id", "quality"), ["doc_id"])


@query("u04_intersect", "SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels")
def u04(spark, d):
    return table(spark, d, "documents").where("lang = 'en'").select("doc_id").intersect(table(spark, d, "labels").select("doc_id"))


@query("u05_key_differences", "SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def u05(spark, d):
    return joins.key_differences(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"])


@query("u07_distinct", "SELECT DISTINCT lang, source FROM documents")
def u07(spark, d):
    return table(spark, d, "documents").select("lang", "source").distinct()


@query("s15_labelled_slice", "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) BETWEEN 4 AND 8")
def s15(spark, d):
    return R.labelled_slice(table(spark, d, "documents"), "source", "doc_id", 5, 3).select("doc_id", "source")


@query("s08_row_range", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey >= 100 AND l_orderkey < 500")
def s08(spark, d):
    return R.row_range(table(spark, d, "lineitem"), "l_orderkey", 100, 500, ["l_orderkey", "l_linenumber"])


@query("s11_shapes", "SELECT 'OBJECT<k: BIGINT>' AS shape, count(*) AS n FROM events WHERE json_keys(props) = ['k'] AND json_type(props, '$.k') = 'UBIGINT' HAVING count(*) > 0")
def s11(spark, d):
    return table(spark, d, "events").groupBy(R.shape(F.parse_json("props")).alias("shape")).agg(F.count("*").alias("n"))


@query("s11_profile", "WITH r AS (SELECT 'conv_id' AS field, 'BIGINT' AS type, 0 AS size FROM conversations UNION ALL SELECT 'role', 'STRING', len(role) FROM conversations UNION ALL SELECT 'text', 'STRING', len(text) FROM conversations UNION ALL SELECT 'words', 'ARRAY', len(string_split(text, ' ')) FROM conversations UNION ALL SELECT 'at', 'OBJECT', 2 FROM conversations) SELECT field, type, count(*) AS n, min(size) AS least, max(size) AS most FROM r GROUP BY ALL")
def s11_profile(spark, d):
    raw = F.parse_json(F.to_json(F.struct("conv_id", "role", "text", F.split("text", " ").alias("words"), F.struct("conv_id", "turn").alias("at"))))
    return R.shape_profile(table(spark, d, "conversations").select(raw.alias("raw"))).fillna(0, ["least", "most"])


@query("k10_wide_to_long", "SELECT s_suppkey, u.f AS feature, u.v AS value FROM (SELECT s_suppkey, unnest([{'f': 's_nationkey', 'v': s_nationkey::DOUBLE}, {'f': 's_acctbal', 'v': s_acctbal}]) AS u FROM supplier)")
def k10(spark, d):
    wide = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("s_nationkey"), "s_acctbal")
    return sinks.wide_to_long(wide, ["s_suppkey"])


@query("x12_hit_counts_by_feature")
def x12_counts(spark, d):
    found = documents(spark, d).select(F.explode(spans.span_function()(F.col("text"))).alias("h"))
    return found.groupBy("h.feature", "h.subtype").agg(F.count("*").alias("n"))
