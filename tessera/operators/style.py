"""Discovery of style markers: n-gram counts, lift, representatives and ad-hoc pattern censuses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ngrams, plain_quotes, rate, skipped, strip
from ..storage import cut
from .sampling import per_group


def corpus_counts(docs: DataFrame, corpus: str, doc: str, words: Column, sizes: Sequence[int] = (1, 2, 3), examples: int = 20) -> DataFrame:
    """Count, documents and the first documents of each n-gram of each corpus. Counts are added up by document before the shuffle."""
    grams = F.flatten(F.array(*[ngrams(F.col("_w"), n) for n in sizes]))
    long = docs.select(corpus, doc, words.alias("_w")).select(corpus, doc, F.explode(grams).alias("phrase")).where(~skipped(F.col("phrase")))
    by_doc = long.groupBy(corpus, "phrase", doc).agg(F.count("*").alias("_n"))
    sums = by_doc.groupBy(corpus, "phrase").agg(F.sum("_n").alias("count"), F.count("*").alias("docs"), F.min(doc).alias("first_doc"))
    if examples <= 1:
        return sums
    few = per_group(by_doc, [corpus, "phrase"], [doc], examples)  # limited before they are gathered
    return sums.drop("first_doc").join(few.groupBy(corpus, "phrase").agg(F.array_sort(F.collect_list(doc)).alias("examples")), [corpus, "phrase"])


def lift(counts: DataFrame, totals: DataFrame, corpus: str, model: str, reference: str, least_count: int = 1, least_docs: int = 1, least_lift: float = 0.0, prior: float = 0.5) -> DataFrame:
    """Lift of each phrase of one corpus over another with an additive prior over the joint vocabulary. totals: rows (corpus, tokens, docs), two of them."""
    side = lambda name, c: F.max(F.when(F.col(corpus) == name, F.col(c)))
    wide = counts.where(F.col(corpus).isin(model, reference)).groupBy("phrase").agg(*[F.coalesce(side(n, c), F.lit(0)).alias(f"{p}_{c}") for p, n in (("model", model), ("reference", reference)) for c in ("count", "docs")])
    sums = totals.agg(*[F.coalesce(side(n, c), F.lit(0)).alias(f"_{p}_{c}") for p, n in (("m", model), ("r", reference)) for c in ("tokens", "docs")])
    wide = cut(wide)  # its rows are read and counted
    size = wide.agg(F.count("*").alias("_v"))
    c = F.col
    joined = wide.crossJoin(F.broadcast(sums)).crossJoin(F.broadcast(size))  # one row each
    smooth = lambda n, t: (c(n) + prior) / (c(t) + prior * c("_v"))
    out = joined.withColumn("lift", smooth("model_count", "_m_tokens") / F.greatest(F.lit(1e-12), smooth("reference_count", "_r_tokens")))
    out = out.withColumn("model_per_1k", rate(c("model_count"), c("_m_tokens"))).withColumn("reference_per_1k", rate(c("reference_count"), c("_r_tokens")))
    out = out.withColumn("model_doc_rate", c("model_docs") / F.greatest(F.lit(1), c("_m_docs")))
    out = out.withColumn("score", F.log2("lift") * F.sqrt("model_docs") * (1.0 + c("model_doc_rate")))
    return out.where((c("model_count") >= least_count) & (c("model_count") > 0) & (c("model_docs") >= least_docs) & (c("lift") >= least_lift)).drop("_m_tokens", "_m_docs", "_r_tokens", "_r_docs", "_v")


def families(phrase: Column, rules: Sequence[tuple[str, str]], default: str = "other") -> Column:
    """The family of the first rule (pattern, family) that fits."""
    out = F.lit(default)
    for pattern, name in reversed(rules):
        out = F.when(phrase.rlike(pattern), name).otherwise(out)
    return out


def pattern_census(docs: DataFrame, keys: Sequence[str], text: Column, tokens: Column, specs: Mapping[str, str]) -> DataFrame:
    """Hits, documents with a hit and rate of each pattern by group. Patterns are literal columns, compiled once a task."""
    named = {name: f"_p{i}" for i, name in enumerate(specs)}
    wide = docs.select(*keys, tokens.alias("_t"), *[F.regexp_count(text, F.lit(p)).alias(named[n]) for n, p in specs.items()])
    sums = wide.groupBy(*keys).agg(F.count("*").alias("docs"), F.sum("_t").alias("tokens"), *[F.struct(F.sum(c).alias("hits"), F.count_if(F.col(c) > 0).alias("docs_with_hit")).alias(c) for c in named.values()])
    pairs = ", ".join(f"'{n}', `{c}`" for n, c in named.items())
    out = sums.selectExpr(*keys, "docs", "tokens", f"stack({len(named)}, {pairs}) AS (pattern, s)").select(*keys, "pattern", "docs", "tokens", "s.hits", "s.docs_with_hit")
    return out.withColumn("per_1k_tokens", rate(F.col("hits"), F.col("tokens"))).withColumn("doc_prevalence", rate(F.col("docs_with_hit"), F.col("docs"), 1.0))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """A list of words or trigrams (one row each, lower case, straight quotes) from a file: text with one a line, or JSON with an array of texts or of arrays whose first item is the text."""
    if not path.rstrip("/").endswith(".json"):
        found = spark.read.text(path).select(F.col("value").alias("phrase"))
    else:
        whole = spark.read.text(path, wholetext=True).select(F.explode(F.try_variant_get(F.parse_json("value"), "$", "array<variant>")).alias("v"))
        found = whole.select(F.coalesce(F.try_variant_get("v", "$[0]", "string"), F.try_variant_get("v", "$", "string")).alias("phrase"))
    return found.select(plain_quotes(F.lower(strip(F.col("phrase")))).alias("phrase")).where("phrase <> ''").distinct()


def list_hits(words: DataFrame, doc: str, column: str, known: DataFrame) -> DataFrame:
    """X14 for long lists: rows (doc, hits), how many items of an array column are in a table of phrases; 0 where none is. Items are counted by document and phrase before they meet the list, which Spark sends around if it is small."""
    counts = words.select(doc, F.explode(column).alias("phrase")).groupBy(doc, "phrase").agg(F.count("*").alias("_n"))
    hits = counts.join(known.select("phrase").distinct(), "phrase").groupBy(doc).agg(F.sum("_n").alias("hits"))
    return words.select(doc).join(hits, doc, "left").fillna(0, ["hits"])
