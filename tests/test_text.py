import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import patterns as P
from tessera.functions import spans, text

TEXTS = [
    "", "It's not only fast but also small. It isn't just a tool; it's a way of life.", "This is not a bug, it is a feature. This is not a bug, it is a feature.",
    "Great question! Here are three: red, green, and blue.\n\nI hope this helps!", "Certainly, let me know if you'd like more.", "Überall, ça va — naïve… “quotes” ‘single’",
    "x = {1, 2}\n```\na, b and c\n```\nApples, pears and plums.", "Overall, fine. Overall, it works.", "𝒜 😀 delve delves Delving tapestries", "a | b, c and d | e", "can't won't don’t 'quoted' o'clock",
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")


@pytest.mark.parametrize("family", [*P.FAMILIES, "neutral", "discovered"])
def test_counts_equal_python(df, family):
    patterns = {"neutral": P.neutral("common") | P.neutral("controls"), "discovered": P.DISCOVERED}.get(family) or P.FAMILIES[family]
    got = df.select("i", *[c.alias(k) for k, c in text.items(F.col("t"), patterns).items()]).collect()
    for r in got:
        for k, p in patterns.items():
            assert r[k] == len(re.findall(p, TEXTS[r["i"]], re.I | re.M | re.U)), (k, TEXTS[r["i"]])


def test_basic_measures(df):
    t = F.col("t")
    got = df.select("i", text.tokens(t).alias("n"), text.sentences(t).alias("s"), F.size(text.paragraphs(t)).alias("p"), text.words(t).alias("w")).orderBy("i").collect()
    for r, x in zip(got, TEXTS, strict=True):
        assert r["s"] == max(1, len(re.findall(P.SENTENCE_END, x))) and r["w"] == len(x.split())
        assert r["p"] == len([p for p in re.split(r"\n\s*\n+", x) if p.strip()])
    assert (got[0]["n"], got[0]["s"], got[0]["p"]) == (0, 1, 0)
    assert got[1]["n"] == len(re.findall(P.WORD, TEXTS[1]))


def test_uniformity(spark):
    arrays = [([],), ([0.0, 0.0],), ([5.0],), ([4.0, 4.0, 4.0],), ([1.0, 3.0],)]
    got = [r[0] for r in spark.createDataFrame(arrays, "a array<double>").select(text.uniformity(F.col("a"))).collect()]
    assert got == pytest.approx([0, 0, 1, 1, 1 / (1 + 1 / 2)])


def test_hits_and_contrasts_are_where_they_say():
    for t in TEXTS:
        for feature, sub, start, end, found, context in spans.hits(t):
            assert t[start:end] == found and found in context and feature and sub
        last = -1
        for _, start, end, _ in spans.contrasts(t):
            assert start >= last
            last = end
    assert [h[1] for h in spans.hits(TEXTS[2]) if h[0] == "contrastive_negation"] == ["not_x_its_y"] * 2


def test_patterns_that_are_not_run_would_not_match():
    every = [p for f in P.FAMILIES.values() for p in f.values()] + list(P.SURFACE_CONTRASTS.values()) + [P.RULE_OF_THREE]
    odd = ["It ıs NOT thıs, it ıs that.", "ſure, robuſt", "TAPESTRıES", "They aren't cats. They are dogs.", "It's no longer here. It is there.", "He didn't walk. They walked."]
    for t in TEXTS + odd:
        for p in every:
            assert [m.span() for m in spans.matches(p, t, spans.fold(t))] == [m.span() for m in spans.compiled(p).finditer(t)], (p, t)


def test_triads_are_not_in_code_or_tables():
    assert [m.group() for m in spans.triads(TEXTS[6])] == [m.group() for m in re.finditer(P.RULE_OF_THREE, "Apples, pears and plums.", re.I)]
    assert not spans.triads(TEXTS[9])
    assert len(spans.triads("red, green, and blue")) == 1


def test_opportunities():
    assert spans.offsets("hello brave world", "token_start", 2) == [0, 6]
    assert spans.offsets("   ", "document_start") == [] and spans.offsets("One. Two. Three.", "clause_boundary") == [0, 5, 10]
    assert spans.offsets("One. Two. Three.", "final_clause_boundary") == [10]
    with pytest.raises(ValueError, match="no such kind"):
        spans.offsets("x", "nowhere")
    found = spans.opportunities("The end of the day. In the end.", ["neutral_common_of_the", "neutral_common_controls"])
    assert [(o[0], o[2]) for o in found if o[3]] == [("neutral_common_controls", 0), ("neutral_common_controls", 8), ("neutral_common_of_the", 8), ("neutral_common_controls", 11), ("neutral_common_controls", 20), ("neutral_common_controls", 23)]
    done = spans.opportunities("They were fast, safe, and useful. Big, small.", ["rule_of_three"])
    assert sum(o[3] for o in done) == 1 and len(done) == 2
    assert len(P.opportunity_specs()) == 30


def test_shingles_and_signatures(spark):
    assert spans.shingles("The  CAT sat\n on", 2) == ["cat sat", "sat on", "the cat"]
    assert spans.shingles("Straße", 5) == ["strasse"] and spans.shingles(" ", 5) == []
    got = spark.createDataFrame([("a b c d e f",), ("",), (None,)], "t string").select(spans.minhash_function(8)(F.col("t")).alias("s")).select("s", F.size(spans.bands(F.col("s"), 3)).alias("n"), spans.estimated_jaccard(F.col("s"), F.col("s")).alias("j")).collect()
    assert got[0]["s"] == [min(spans.blake64(i, x) for x in spans.shingles("a b c d e f")) for i in range(8)] and (got[0]["n"], got[0]["j"]) == (2, 1.0)
    assert got[1]["s"] == [] and got[1]["j"] == 0.0 and got[2]["s"] is None


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("# Head\n> quote\n- item\n1. first\n2)\n---\n| a | b |\n|---|---|\n**bold** _it_ `code` [x](http://y) ![alt](z)", "Head\nquote\nitem\nfirst\na b\nbold it code x alt"),
        ("```python\nx\n```\n<b>hi</b><br/>there", "x\nhi\nthere"),
        ("a\r\n\r\n\r\n\r\nb", "a\n\nb"),
    ],
)
def test_markdown(spark, given, want):
    got = spark.createDataFrame([(given,)], "t string").select(text.without_markdown(F.col("t"))).first()[0]
    assert got == want


def test_reasoning_and_roles(spark):
    cases = [("<think>a</think>b", "b"), ("x <Reasoning> y", "x"), ("```thinking\nz\n``` answer", "answer"), ("p ```reasoning q", "p"), ("plain", "plain")]
    got = [r[0] for r in spark.createDataFrame([(a,) for a, _ in cases], "t string").select(text.final_answer(F.col("t"))).collect()]
    assert got == [b for _, b in cases]
    assert spark.createDataFrame([("Assistant\nhello\n user \nbye",)], "t string").select(text.without_roles(F.col("t"))).first()[0] == "hello\nbye"


def test_ratios(spark):
    rows = [(1.0, 2.0), (1.0, 0.0), (0.0, 0.0), (1.0, None), (None, 0.0)]
    got = spark.createDataFrame(rows, "a double, b double").select(text.safe_ratio(F.col("a"), F.col("b")), text.safe_rate(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [0.5, math.inf, 0.0, None, None] and [r[1] for r in got] == [0.5, 0.0, 0.0, 0.0, 0.0]


def test_weighted_score_is_clamped(spark):
    got = spark.range(1).select(text.weighted_score(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("a"), text.weighted_score(F.lit(99.0), F.lit(9.0), F.lit(9.0)).alias("b")).first()
    assert got["b"] == pytest.approx(100.0) and 0 < got["a"] < 2


def test_skipped_phrases(spark):
    grams = ["the cat", "cat of", "it is", "of", "ab", "123", "cat sat", "- item", "cat"]
    got = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "g string").select(text.skipped(F.col("g"))).collect()]
    assert got == [True, True, True, True, True, True, False, True, False]
    assert random.Random(1).random() > 0


#: A text for each term, and its penalty worked out by hand; nothing else in it counts.
PENALTIES = {
    "": 1.0,
    "a plain line of words": 0.0,
    "aaaa bbbb cccc schema": 0.55,  # one code mark
    "aaaaaaaaaaaaaaaaaaa=": 0.4,  # one symbol of 20 characters, times 8
    "a = = = b": 3.0,  # 4.8 for symbols is capped at 2, and 2 letters of 5 characters are few
    "aaaaaaaaaaaaaaaaaa..": 0.25,  # one run of symbols
    "on 2024-01-02T abcdefghijklmnop": 0.55,  # a date with a letter behind it
    "abcdefgh . . . abcdefgh": 0.6,  # one mark three times
    "NASA abc DEF": 0.5,  # two words in capitals
    "the changelog here": 0.6,
    "newest  games like this": 0.6,
    "12 34 56 a": 1.0,  # one letter of seven characters
    "Aaa Bbb Ccc Ddd Eee Fff": 0.24,  # the fifth and sixth of a run
    "Aaa bbb Ccc ddd Eee fff Ggg hhh": 0.5,  # half of the words, a quarter is free, times 2
    "aaa and bbb or ccc but ddd eee": 0.645,  # 0.375 less 0.16, times 3
    "aaa very bbb quite ccc often ddd eee": 1.18,  # 0.375 less 0.08, times 4
    "schema NASA changelog": 1.4,  # terms add up: 0.55, 0.25 and 0.6
}


def test_quality_penalty(spark):
    rows = spark.createDataFrame(list(PENALTIES.items()), "t string, want double").select("t", "want", text.quality_penalty(F.col("t")).alias("got")).collect()
    assert {r["t"]: r["got"] for r in rows} == pytest.approx(PENALTIES)



def test_quality_penalty_computes_the_text_once(spark):
    """Every term names the stripped text, and a condition would strip it again for each of them; a null text has no penalty and no words count as none."""
    row = spark.createDataFrame([("... --- ...", None)], "t string, none string").select(*(text.quality_penalty(F.col(c)).alias(c) for c in ("t", "none"))).first()
    assert row["t"] == pytest.approx(3 * 0.25) and row["none"] is None
    plan = spark.range(1).select(text.quality_penalty(F.concat(F.lit("a"), F.col("id").cast("string"))).alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?U)^\\s+|\\s+$") == 1 and plan.count("A-Za-z]+\\b") == 1
