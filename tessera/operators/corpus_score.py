"""Scores of outputs by lists of words and trigrams and by contrasts: of each output, and of a group's outputs as one text.

A group is scored as if its outputs of more than some characters were joined by blank lines, in a given order, without joining
them: sums over outputs, separators for characters, and trigrams that reach from one output into the next. For these an output
leaves its first and last two tokens; outputs are dealt by ranges of group and order, each takes the two tokens before it from its
range, and the first ones of a range from the ranges before, of which each group has one row a range. So a group of any size is spread.
Lists are tables of any length; an output's words and trigrams meet them in a join, and only hits are counted and moved.

Contrasts are found within outputs; one that would reach over the blank line between two outputs is not counted.

Defined cases: null texts are no valid outputs, but samples; a null group is a group; outputs of equal order follow their texts' hashes;
outputs without a token lie in no trigram's way; repeated rows count each; groups without a valid output score 0; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import spans
from ..functions.text import plain_quotes, safe_rate, weighted_score
from ..storage import cut
from .sampling import per_group

KINDS = ("word", "trigram")


def phrase_lists(words: DataFrame, trigrams: DataFrame) -> DataFrame:
    """(kind, phrase) of two tables with a column phrase, each phrase once."""
    of = lambda df, kind: df.select(F.lit(kind).alias("kind"), "phrase")
    return of(words, "word").unionByName(of(trigrams, "trigram")).where("phrase IS NOT NULL").distinct()


def _words(text: Column) -> Column:
    """The tokens of benchmark_tokens by one pattern, which takes a run of letters and apostrophes whole or not at all: nothing is done token by token."""
    return F.regexp_extract_all(plain_quotes(F.lower(text)), F.lit(r"(?<![a-z'])'*+([a-z]++(?:'[a-z]++)?)'*+(?![a-z'])"), F.lit(1))


def _trigrams(words: Column) -> Column:
    """The trigrams of an array of words without blanks: what follows each start of a word in the joined words."""
    return F.regexp_extract_all(F.array_join(words, " "), F.lit("(?<![^ ])(?=([^ ]++ [^ ]++ [^ ]++))"), F.lit(1))


def _kind(phrase: Column) -> Column:
    return F.when(F.contains(phrase, F.lit(" ")), "trigram").otherwise("word")


def _met(grams: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (_g, kind, phrase) of the phrases that are listed."""
    return grams.join(known.where(F.col("kind") == _kind(F.col("phrase"))), "phrase").select("_g", "kind", "phrase")


def _phrases(valid: DataFrame) -> DataFrame:
    """(_g, phrase): all words and trigrams within outputs."""
    tokens = valid.select("_g", _words(F.col("_t")).alias("w"))
    return tokens.select("_g", F.explode(F.concat("w", _trigrams(F.col("w")))).alias("phrase"))


def _last_two(*tokens: Column) -> Column:
    all_ = F.concat(*[F.coalesce(t, F.array().cast("array<string>")) for t in tokens])
    return F.slice(all_, F.greatest(F.size(all_) - 1, F.lit(1)), 2)


def _seams(ends: DataFrame) -> DataFrame:
    """(_g, phrase): trigrams that reach into an output from those before it. ends: rows (_g, _o, head, tail), the first and last two tokens."""
    ranges = cut(ends.repartitionByRange("_g", "_o").withColumn("_r", F.spark_partition_id()))
    w = Window.partitionBy("_r", "_g").orderBy("_o")
    near = ranges.withColumn("_b", F.concat(F.coalesce(F.lag("tail", 2).over(w), F.array().cast("array<string>")), F.coalesce(F.lag("tail", 1).over(w), F.array().cast("array<string>"))))
    left = near.groupBy("_r", "_g").agg(F.max_by(_last_two(F.col("_b"), F.col("tail")), "_o").alias("_e"))
    before = Window.partitionBy("_g").orderBy("_r")  # one row a range
    carried = left.select("_r", F.col("_g").alias("_h"), _last_two(F.lag("_e", 2).over(before), F.lag("_e", 1).over(before)).alias("_c"))
    joined = near.join(carried.withColumnRenamed("_r", "_s"), (F.col("_r") == F.col("_s")) & F.col("_g").eqNullSafe(F.col("_h")))
    return joined.select("_g", F.explode(_trigrams(F.concat(_last_two(F.col("_c"), F.col("_b")), F.col("head")))).alias("phrase"))


def _valid(docs: DataFrame, group: str, text: str, order: Sequence[str], least: int) -> DataFrame:
    """(_g, _o, _t) of the outputs of more than so many characters."""
    key = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.xxhash64(F.col(text)).alias("h"))
    return docs.select(F.col(group).alias("_g"), key.alias("_o"), F.col(text).alias("_t")).where(F.length("_t") > least)


def _ends(valid: DataFrame, *more: Column) -> DataFrame:
    tokens = valid.select("_g", "_o", _words(F.col("_t")).alias("w"), *more)
    return tokens.select("_g", "_o", F.size("w").alias("n"), F.slice("w", 1, 2).alias("head"), _last_two(F.col("w")).alias("tail"), *[c for c in tokens.columns if c not in ("_g", "_o", "w")])


def _hits(valid: DataFrame, ends: DataFrame, known: DataFrame) -> DataFrame:
    grams = _met(_phrases(valid), known).unionByName(_met(_seams(ends.where("n > 0").select("_g", "_o", "head", "tail")), known))
    return grams.groupBy("_g", "kind", "phrase").agg(F.count("*").alias("hits"))


def joined_hits(docs: DataFrame, group: str, text: str, order: Sequence[str], known: DataFrame, least: int = 300) -> DataFrame:
    """(group, kind, phrase, hits): how often each listed phrase is in a group's joined outputs of more than so many characters."""
    valid = _valid(docs, group, text, order, least)
    return _hits(valid, _ends(valid), known).withColumnRenamed("_g", group)


def top_hits(hits: DataFrame, group: str, n: int = 50) -> DataFrame:
    """The n most frequent phrases of each group and kind, then by phrase, with their rank."""
    first = per_group(hits, [group, "kind"], [F.desc("hits"), "phrase"], n)
    return first.select(group, "kind", "phrase", "hits", F.row_number().over(Window.partitionBy(group, "kind").orderBy(F.desc("hits"), "phrase")).alias("rank"))


def _scored(sums: DataFrame) -> DataFrame:
    """Adds the three rates and the score to counts."""
    c = F.col
    rates = sums.withColumn("words_per_1k", safe_rate(c("word_hits"), c("tokens")) * 1000.0).withColumn("trigrams_per_1k", safe_rate(c("trigram_hits"), c("tokens")) * 1000.0).withColumn("contrasts_per_1k_chars", safe_rate(c("contrast_hits"), c("chars")) * 1000.0)
    score = F.when(c("chars") > 0, weighted_score(c("words_per_1k"), c("trigrams_per_1k"), c("contrasts_per_1k_chars"))).otherwise(0.0)
    return rates.withColumn("score", score)


def _by_kind(hits: DataFrame) -> DataFrame:
    return hits.groupBy("_g").agg(*[F.sum(F.when(F.col("kind") == k, F.col("hits")).otherwise(0)).alias(f"{k}_hits") for k in KINDS]).withColumnRenamed("_g", "_k")


def joined_scores(docs: DataFrame, group: str, text: str, order: Sequence[str], known: DataFrame, least: int = 300) -> DataFrame:
    """For each group the number of outputs, of valid ones, characters and tokens of the joined text, hits of each kind, rates and score."""
    valid = _valid(docs, group, text, order, least)
    # Read for the sums and for the seams: a few words of each output.
    ends = cut(_ends(valid, F.length("_t").alias("c"), spans.contrast_count(F.col("_t")).alias("x")))
    sums = ends.groupBy("_g").agg(F.count("*").alias("valid"), (F.sum("c") + 2 * (F.count("*") - 1)).alias("chars"), F.sum("n").alias("tokens"), F.sum("x").alias("contrast_hits"))
    samples = docs.groupBy(F.col(group).alias("_s")).agg(F.count("*").alias("samples"))
    out = samples.join(sums, F.col("_s").eqNullSafe(F.col("_g")), "left").drop("_g")
    out = out.join(_by_kind(_hits(valid, ends, known)), F.col("_s").eqNullSafe(F.col("_k")), "left").drop("_k")
    counts = ["valid", "chars", "tokens", "word_hits", "trigram_hits", "contrast_hits"]
    return _scored(out.select(F.col("_s").alias(group), "samples", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts]))


def output_scores(docs: DataFrame, doc: str, text: str, known: DataFrame) -> DataFrame:
    """Characters, tokens, hits of each kind, rates and score of each output by itself. Rows of one id and unlike texts are an error of the input; repeated ids count as one output's hits."""
    rows = docs.select(F.col(doc).alias("_g"), F.coalesce(text, F.lit("")).alias("_t"))
    hits = _by_kind(_met(_phrases(rows), known).groupBy("_g", "kind", "phrase").agg(F.count("*").alias("hits")))
    own = rows.select("_g", F.length("_t").alias("chars"), F.size(_words(F.col("_t"))).alias("tokens"), spans.contrast_count(F.col("_t")).alias("contrast_hits"))
    out = own.join(hits, F.col("_g").eqNullSafe(F.col("_k")), "left").drop("_k")
    counts = ["chars", "tokens", "word_hits", "trigram_hits", "contrast_hits"]
    return _scored(out.select(F.col("_g").alias(doc), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts]))


def first_contrasts(docs: DataFrame, group: str, text: str, order: Sequence[str], n: int = 100, least: int = 300) -> DataFrame:
    """(group, rank, pattern, match): the first n contrasts of each group's outputs, in their order."""
    found = _valid(docs, group, text, order, least).select("_g", "_o", F.explode(spans.contrast_matches(F.col("_t"))).alias("m"))
    first = per_group(found.select("_g", "_o", F.col("m.start").alias("start"), F.col("m.name").alias("pattern"), F.col("m.match").alias("match")), ["_g"], ["_o", "start"], n)
    return first.select(F.col("_g").alias(group), F.row_number().over(Window.partitionBy("_g").orderBy("_o", "start")).alias("rank"), "pattern", "match")
