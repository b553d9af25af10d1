"""Text kernels over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import spans, text
from ..operators import corpus_score, style
from .base import PLAIN, TOKENS, documents, query, quoted, sql_count, table



@query("x01_tokens", f"SELECT doc_id, {TOKENS} AS tokens FROM documents")
def x01(spark, d):
    return table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("tokens"))


@query("x02_sentences", r"SELECT doc_id, greatest(1, len(regexp_extract_all(text, '[.!?]+(?:\s+|$)'))) AS sentences FROM documents")
def x02(spark, d):
    return table(spark, d, "documents").select("doc_id", text.sentences(F.col("text")).alias("sentences"))


_PARAGRAPHS = r"list_filter(list_transform(string_split_regex(text, '\n\s*\n+'), lambda p: trim(p, E' \t\n\r')), lambda p: p <> '')"


@query("x03_paragraphs", f"SELECT doc_id, len({_PARAGRAPHS}) AS paragraphs, len(list_filter(list_transform(string_split(text, E'\\n\\n'), lambda p: trim(p, E' \\t\\n\\r')), lambda p: p <> '')) AS sampler_paragraphs FROM documents")
def x03(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.paragraphs(F.col("text"))).cast("long").alias("paragraphs"), F.size(text.paragraphs(F.col("text"), "\n\n")).cast("long").alias("sampler_paragraphs"))


@query(
    "x04_rhythm",
    rf"""
WITH c AS (SELECT doc_id, list_transform(string_split(text, E'\n'), lambda p: {TOKENS.replace('text,', 'p,')}::DOUBLE) AS n FROM documents),
m AS (SELECT doc_id, n, list_avg(n) AS mean FROM c),
s AS (SELECT doc_id, mean, CASE WHEN len(n) < 2 THEN 0 ELSE sqrt(list_sum(list_transform(n, lambda x: (x - mean) * (x - mean))) / len(n)) END AS dev FROM m)
SELECT doc_id, round(CASE WHEN mean > 0 THEN 1.0::DOUBLE / (1.0::DOUBLE + dev / mean) ELSE 0 END, 9) AS uniformity FROM s
""",
)
def x04(spark, d):
    lines = F.transform(F.split(F.col("text"), "\n"), lambda p: text.tokens(p).cast("double"))
    return documents(spark, d).select("doc_id", F.round(text.uniformity(lines), 9).alias("uniformity"))


def _family(name, family):
    cols = ", ".join(f"{sql_count(p)} AS {k}" for k, p in family.items())

    @query(name, f"SELECT doc_id, {cols} FROM (SELECT doc_id, {PLAIN} AS plain FROM documents)")
    def run(spark, d):
        return documents(spark, d).select("doc_id", *[c.alias(k) for k, c in text.items(F.col("text"), family).items()])


_family("x07_stock_lexicon", P.STOCK_LEXICON)
_family("x07_candidate_lexicon", P.CANDIDATE_LEXICON)
_family("x05_neutral_controls", P.neutral("controls"))
_family("x05_neutral_common", P.neutral("common"))
_family("x05_discovered", P.DISCOVERED)


@query("x09_punctuation", "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, {quoted(p)})) AS {k}" for k, p in P.PUNCTUATION.items()) + " FROM documents")
def x09(spark, d):
    return table(spark, d, "documents").select("doc_id", *[c.alias(k) for k, c in text.items(F.col("text"), P.PUNCTUATION).items()])


@query("x06_contrastive_negation")
def x06(spark, d):
    return documents(spark, d).select("doc_id", *[c.alias(k) for k, c in text.items(F.col("text"), P.CONTRASTIVE_NEGATION).items()])


@query("x08_openers_closers")
def x08(spark, d):
    return documents(spark, d).select("doc_id", *[c.alias(k) for k, c in text.items(F.col("text"), P.STOCK_OPENERS | P.STOCK_CLOSERS).items()])


@query("x10_rule_of_three")
def x10(spark, d):
    return documents(spark, d).select("doc_id", spans.triad_count(F.col("text")).alias("rule_of_three"))


@query("x11_derived_rates", "SELECT doc_id, tokens, lexicon, lexicon::DOUBLE * 1000.0::DOUBLE / greatest(tokens::DOUBLE, 1.0::DOUBLE) AS lexicon_per_1k FROM (SELECT doc_id, " + TOKENS + " AS tokens, " + " + ".join(sql_count(p) for p in P.STOCK_LEXICON.values()) + f" AS lexicon FROM (SELECT doc_id, text, {PLAIN} AS plain FROM documents))")
def x11(spark, d):
    lexicon = text.family_counts(F.col("text"), {"stock_lexicon": P.STOCK_LEXICON})["stock_lexicon"]
    return table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("tokens"), lexicon.alias("lexicon")).withColumn("lexicon_per_1k", text.rate(F.col("lexicon"), F.col("tokens")))


@query("x12_hit_spans")
def x12(spark, d):
    found = documents(spark, d).select("doc_id", F.explode(spans.span_function()(F.col("text"))).alias("h"))
    return found.select("doc_id", "h.*")


_WORDS = "list_filter(list_transform(regexp_extract_all(lower(text), '[a-z'']+'), lambda t: trim(t, '''')), lambda t: regexp_full_match(t, '[a-z]+(?:''[a-z]+)?'))"


@query("x13_benchmark_tokens", f"SELECT doc_id, len({_WORDS}) AS n, coalesce(array_to_string({_WORDS}, ' '), '') AS words FROM documents")
def x13(spark, d):
    return documents(spark, d).select("doc_id", text.benchmark_tokens(F.col("text")).alias("w")).select("doc_id", F.size("w").cast("long").alias("n"), F.array_join("w", " ").alias("words"))


#: Lists are a parameter of the operator; the test texts are invented, so the query counts words that they have.
_LISTED, _TRIGRAMS = ("the", "of", "an", "hand"), ("of the and", "the of the", "to the of")


@query("x14_list_hits", f"WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents) SELECT doc_id, len(list_filter(w, lambda t: t IN ('the', 'of', 'an', 'hand'))) AS word_hits, CASE WHEN len(w) < 3 THEN 0 ELSE len(list_filter(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]), lambda t: t IN ('of the and', 'the of the', 'to the of'))) END AS trigram_hits FROM w")
def x14(spark, d):
    w = documents(spark, d).select("doc_id", text.benchmark_tokens(F.col("text")).alias("w"))
    return w.select("doc_id", text.listed(F.col("w"), _LISTED).alias("word_hits"), text.listed(text.ngrams(F.col("w"), 3), _TRIGRAMS).alias("trigram_hits"))


@query("x14_hits_by_table", f"WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents) SELECT doc_id, len(list_filter(w, lambda t: t IN ('the', 'of', 'an', 'hand'))) AS hits FROM w")
def x14_by_table(spark, d):
    """The same against a table of words, which may be long."""
    known = spark.createDataFrame([(w,) for w in _LISTED], "phrase string")
    return style.list_hits(documents(spark, d).select("doc_id", text.benchmark_tokens(F.col("text")).alias("w")), "doc_id", "w", known)


@query("x15_surface_contrasts")
def x15(spark, d):
    return documents(spark, d).select("doc_id", spans.contrast_count(F.col("text")).alias("contrasts"))


def _scaled(x, kind):
    low, high = P.SCORE_RANGES[kind]
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({x} - {low!r}::DOUBLE) / ({high!r}::DOUBLE - {low!r}::DOUBLE)))"


@query("x17_weighted_score", f"WITH w AS (SELECT doc_id, len({_WORDS}) AS n, len(list_filter({_WORDS}, lambda t: t IN ('the', 'of', 'an', 'hand'))) AS h FROM documents), r AS (SELECT doc_id, CASE WHEN n > 0 THEN h::DOUBLE * 1000.0::DOUBLE / n ELSE 0 END AS x FROM w) SELECT doc_id, round(100 * ({_scaled('x', 'words')} * 0.60::DOUBLE + {_scaled('0.0::DOUBLE', 'contrast')} * 0.25::DOUBLE + {_scaled('0.0::DOUBLE', 'trigrams')} * 0.15::DOUBLE), 8) AS score FROM r")
def x17(spark, d):
    w = documents(spark, d).select("doc_id", text.benchmark_tokens(F.col("text")).alias("w"))
    share = text.safe_rate(text.listed(F.col("w"), _LISTED).cast("double") * 1000.0, F.size("w"))
    return w.select("doc_id", F.round(text.weighted_score(share, F.lit(0.0), F.lit(0.0)), 8).alias("score"))


@query("x18_corpus_score", f"WITH w AS (SELECT source, len(text) AS chars, {_WORDS} AS w FROM documents WHERE len(text) > 100) SELECT source, count(*) AS samples, sum(chars)::BIGINT AS chars, sum(len(w))::BIGINT AS tokens, sum(len(list_filter(w, lambda t: t IN ('the', 'of', 'an', 'hand'))))::BIGINT AS word_hits FROM w GROUP BY source")
def x18(spark, d):
    kept = documents(spark, d).where(F.length("text") > 100).select("source", F.length("text").alias("c"), text.benchmark_tokens(F.col("text")).alias("w"))
    return kept.groupBy("source").agg(F.count("*").alias("samples"), F.sum("c").alias("chars"), F.sum(F.size("w")).alias("tokens"), F.sum(text.listed(F.col("w"), _LISTED)).alias("word_hits"))


#: Lists from the passages of the benchmark, as tables: its words of at least six letters, and all its trigrams.
_OF_BENCHMARK = f"b AS (SELECT {_WORDS} AS w FROM benchmark), known AS (SELECT DISTINCT 'word' AS kind, unnest(list_filter(w, lambda t: len(t) >= 6)) AS phrase FROM b UNION SELECT DISTINCT 'trigram', unnest(CASE WHEN len(w) < 3 THEN [] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) FROM b)"
_JOINED = f"j AS (SELECT source, string_agg(text, E'\\n\\n' ORDER BY doc_id) AS text FROM documents WHERE len(text) > 300 GROUP BY source), w AS (SELECT source, {_WORDS} AS w FROM j), p AS (SELECT source, 'word' AS kind, unnest(w) AS phrase FROM w UNION ALL SELECT source, 'trigram', unnest(CASE WHEN len(w) < 3 THEN [] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) FROM w), h AS (SELECT source, kind, phrase, count(*) AS hits FROM p JOIN known USING (kind, phrase) GROUP BY ALL)"


def of_benchmark(spark, d):
    w = table(spark, d, "benchmark").select(text.benchmark_tokens(F.col("text")).alias("w"))
    words = w.select(F.explode("w").alias("phrase")).where(F.length("phrase") >= 6)
    return corpus_score.phrase_lists(words, w.select(F.explode(text.ngrams(F.col("w"), 3)).alias("phrase")))


@query("x17_list_scores")
def x17_lists(spark, d):
    """Each document's score from all three shares."""
    return corpus_score.output_scores(documents(spark, d), "doc_id", "text", of_benchmark(spark, d))


@query("x18_joined_hits", f"WITH {_OF_BENCHMARK}, {_JOINED}, r AS (SELECT *, row_number() OVER (PARTITION BY source, kind ORDER BY hits DESC, phrase) AS rank FROM h) SELECT * FROM r WHERE rank <= 50")
def x18_hits(spark, d):
    """The 50 most frequent listed words and trigrams of each source's joined documents."""
    hits = corpus_score.joined_hits(documents(spark, d), "source", "text", ["doc_id"], of_benchmark(spark, d))
    return corpus_score.top_hits(hits, "source")


@query("x18_joined_scores")
def x18_scores(spark, d):
    """Each source's documents scored as one joined text."""
    return corpus_score.joined_scores(documents(spark, d), "source", "text", ["doc_id"], of_benchmark(spark, d))


@query("x18_first_contrasts")
def x18_contrasts(spark, d):
    return corpus_score.first_contrasts(documents(spark, d), "source", "text", ["doc_id"])


_MARKED = "CASE WHEN doc_id % 3 = 0 THEN '<think>' || substr(text, 1, 50) || '</think> ' || text WHEN doc_id % 3 = 1 THEN text || ' <think>' || text ELSE text END"


@query("x19_final_answer", f"SELECT doc_id, trim(regexp_replace(regexp_replace({_MARKED}, '(?is)<\\s*think\\s*>.*?<\\s*/\\s*think\\s*>', '', 'g'), '(?is)<\\s*think\\s*>.*', ''), E' \\t\\n\\r') AS answer FROM documents")
def x19(spark, d):
    i = F.col("doc_id") % 3
    marked = F.when(i == 0, F.concat(F.lit("<think>"), F.substring(F.col("text"), 1, 50), F.lit("</think> "), F.col("text"))).when(i == 1, F.concat(F.col("text"), F.lit(" <think>"), F.col("text"))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", text.final_answer(marked).alias("answer"))


@query("x20_role_lines", "SELECT conv_id, turn, trim(regexp_replace(role || E'\\n' || text, '(?im)^\\s*(?:assistant|user|system)\\s*$\\n?', '', 'g'), E' \\t\\n\\r') AS body FROM conversations")
def x20(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.without_roles(F.concat(F.col("role"), F.lit("\n"), F.col("text"))).alias("body"))


@query("x21_markers", "SELECT source, sum(len(regexp_extract_all(t, '(?i)<\\s*/?\\s*think\\s*>')))::BIGINT AS markers, count(*) FILTER (WHERE len(regexp_extract_all(t, '(?i)<\\s*/?\\s*think\\s*>')) > 0) AS records_with_marker FROM (SELECT source, " + _MARKED + " AS t FROM documents) GROUP BY source")
def x21(spark, d):
    i = F.col("doc_id") % 3
    marked = F.when(i == 0, F.concat(F.lit("<think>"), F.substring(F.col("text"), 1, 50), F.lit("</think> "), F.col("text"))).when(i == 1, F.concat(F.col("text"), F.lit(" <think>"), F.col("text"))).otherwise(F.col("text"))
    n = text.markers(marked)["think_tag"]
    return table(spark, d, "documents").select("source", n.alias("n")).groupBy("source").agg(F.sum("n").alias("markers"), F.count_if(F.col("n") > 0).alias("records_with_marker"))


@query("x22_markdown")
def x22(spark, d):
    return documents(spark, d).select("doc_id", text.without_markdown(F.col("text")).alias("plain"))


@query("x23_one_spaced", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS plain FROM documents")
def x23(spark, d):
    return table(spark, d, "documents").select("doc_id", text.one_spaced(F.col("text")).alias("plain"))


@query("x24_bigrams", f"WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), g AS (SELECT unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM w) SELECT gram, count(*) AS n FROM g WHERE gram NOT IN ('') GROUP BY gram HAVING count(*) >= 20")
def x24(spark, d):
    w = documents(spark, d).select(text.benchmark_tokens(F.col("text")).alias("w"))
    return w.select(F.explode(text.ngrams(F.col("w"), 2)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).where("n >= 20")


_RULES = (("^the ", "article"), (" of ", "of_phrase"), ("ing$", "gerund"))


@query("x25_phrase_family", f"WITH w AS (SELECT {_WORDS} AS w FROM documents), g AS (SELECT unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS gram FROM w) SELECT CASE WHEN starts_with(gram, 'the ') THEN 'article' WHEN gram LIKE '% of %' THEN 'of_phrase' WHEN gram LIKE '%ing' THEN 'gerund' ELSE 'other' END AS family, count(*) AS n FROM g GROUP BY 1")
def x25(spark, d):
    w = documents(spark, d).select(text.benchmark_tokens(F.col("text")).alias("w"))
    return w.select(F.explode(text.ngrams(F.col("w"), 3)).alias("g")).groupBy(style.families(F.col("g"), _RULES).alias("family")).agg(F.count("*").alias("n"))


@query("x26_snippet", "SELECT doc_id, CASE WHEN position('with' IN text) > 0 THEN substr(text, greatest(1, position('with' IN text) - 20), 44) ELSE substr(text, 1, 40) END AS snippet FROM documents")
def x26(spark, d):
    return table(spark, d, "documents").select("doc_id", text.snippet(F.col("text"), "with", 20, 40).alias("snippet"))


@query("x28_minhash")
def x28(spark, d):
    users = table(spark, d, "conversations").where("role = 'user'")
    return users.select("conv_id", "turn", spans.minhash_function()(F.col("text")).alias("s")).select("conv_id", "turn", F.array_join("s", "").alias("signature"), F.size(spans.bands(F.col("s"))).alias("bands"))


@query("x31_opportunities")
def x31(spark, d):
    features = ("neutral_common_of_the", "stock_closers", "rule_of_three", "contrastive_negation", "discovered_additive_transition")
    found = documents(spark, d).select("doc_id", F.explode(spans.opportunity_counts(features)(F.col("text"))).alias("o"))
    return found.groupBy("doc_id", "o.feature", "o.kind").agg(F.sum("o.opportunities").alias("opportunities"), F.sum("o.initiations").alias("initiations"))


@query("x34_log_ratio", "SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN round(log2((s_acctbal + 1e-9) / (1000.0::DOUBLE + 1e-9)), 8) END AS log_ratio FROM supplier")
def x34(spark, d):
    b = F.col("s_acctbal")
    return table(spark, d, "supplier").select("s_suppkey", F.when(b > 0, F.round(text.signed_log_ratio(b, F.lit(1000.0)), 8)).alias("log_ratio"))


@query("x35_hashes", "SELECT doc_id, sha256(text) AS content_hash, left(sha256(text), 12) AS short_hash FROM documents")
def x35(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.col("text"), 256).alias("content_hash"), F.left(F.sha2(F.col("text"), 256), F.lit(12)).alias("short_hash"))


@query("x36_words", r"SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda t: t <> '')) AS words FROM documents")
def x36(spark, d):
    return table(spark, d, "documents").select("doc_id", text.words(F.col("text")).alias("words"))


@query("x37_response_requirements", r"SELECT doc_id, 'Response requirements: aim for about ' || w || CASE WHEN w = 1 THEN ' word.' ELSE ' words.' END AS asked, 2048 AS budget FROM (SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda t: t <> '')) AS w FROM documents)")
def x37(spark, d):
    return table(spark, d, "documents").select("doc_id", text.response_requirements(text.words(F.col("text"))).alias("asked"), text.output_budget(128, 2048).alias("budget"))


@query("x38_edits", "SELECT doc_id, len(regexp_extract_all(text, 'the')) + len(regexp_extract_all(replace(text, 'the', 'a'), '!+')) AS edits, md5(regexp_replace(replace(text, 'the', 'a'), '!+', '.', 'g')) AS edited FROM documents")
def x38(spark, d):
    out, n = text.edited(F.col("text"), [("the", "a"), ("!+", ".")])
    return table(spark, d, "documents").select("doc_id", n.alias("edits"), F.md5(out).alias("edited"))


def _among(words):
    return ", ".join(quoted(w) for w in words)


@query("x39_token_class", rf"WITH t AS (SELECT unnest(string_split(text, ' ')) AS t FROM documents) SELECT CASE WHEN t LIKE E'%\n%' THEN 'line_break' WHEN t = '' THEN 'empty' WHEN regexp_matches(t, {quoted(text.CONTRACTION_MARKS)}) THEN 'contraction_piece' WHEN lower(t) IN ({_among(text.NEGATION_WORDS)}) THEN 'expanded_negation_word' WHEN lower(t) IN ({_among(text.DISCOURSE_WORDS)}) THEN 'discourse_marker_word' WHEN lower(t) IN ({_among(text.STYLE_WORDS)}) THEN 'style_function_word' WHEN regexp_full_match(t, '[.!?]+') THEN 'sentence_boundary' WHEN regexp_full_match(t, '[^\p{{L}}\p{{N}}_]+') THEN 'punctuation' WHEN regexp_matches(t, '[\p{{L}}\p{{N}}_]') THEN 'word' ELSE 'other' END AS class, count(*) AS n FROM t GROUP BY 1")
def x39(spark, d):
    return documents(spark, d).select(F.explode(F.split(F.col("text"), " ")).alias("t")).groupBy(text.token_class(F.col("t")).alias("class")).agg(F.count("*").alias("n"))


@query("x40_metrics", rf"SELECT doc_id, tokens, sentences, tokens::DOUBLE / sentences AS words_per_sentence FROM (SELECT doc_id, {TOKENS} AS tokens, greatest(1, len(regexp_extract_all(text, '[.!?]+(?:\s+|$)'))) AS sentences FROM documents)")
def x40(spark, d):
    return table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("tokens"), text.sentences(F.col("text")).alias("sentences")).withColumn("words_per_sentence", F.col("tokens").cast("double") / F.col("sentences"))


@query("x41_language_label", "SELECT label, count(*) AS n FROM (SELECT CASE WHEN lang = 'en' OR doc_id % 2 = 0 AND lang = 'en' THEN 'en' WHEN doc_id % 2 = 0 THEN lang || '-x' ELSE lang END AS label FROM documents) GROUP BY label")
def x41(spark, d):
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("__label__"), F.col("lang"), F.lit("_X"))).otherwise(F.col("lang"))
    return table(spark, d, "documents").groupBy(text.language_label(raw).alias("label")).agg(F.count("*").alias("n"))


@query("x43_json_maps", "SELECT event_type, key, sum(n)::BIGINT AS n FROM (SELECT event_type, unnest(json_keys(props)) AS key, 1 AS n FROM events) GROUP BY ALL")
def x43(spark, d):
    kept = table(spark, d, "events").select("event_type", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return kept.groupBy("event_type", "key").agg(F.count("*").alias("n"))
