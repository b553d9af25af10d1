"""Scores of joined outputs against plain Python over the joined text."""

import random
import re
from collections import Counter

import pytest

from tessera.functions import patterns, spans
from tessera.operators import corpus_score

WORDS, TRIGRAMS = {"delve", "vivid", "don't"}, {"a b c", "delve into the", "c a b", "b c delve"}


@pytest.fixture(scope="module", autouse=True)
def shared(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


def known(spark):
    of = lambda phrases: spark.createDataFrame([(p,) for p in [*sorted(phrases), sorted(phrases)[0], None]], "phrase string")
    return corpus_score.phrase_lists(of(WORDS), of(TRIGRAMS))


def tokens(text):
    found = [t.strip("'") for t in re.findall("[a-z']+", text.lower().replace("’", "'"))]
    return [t for t in found if re.fullmatch("[a-z]+(?:'[a-z]+)?", t)]


def hits(text):
    w = tokens(text)
    return Counter(("word", t) for t in w if t in WORDS) + Counter(("trigram", t) for t in map(" ".join, zip(w, w[1:], w[2:], strict=False)) if t in TRIGRAMS)


def outputs(n=120, seed=5):
    """Many short outputs, so trigrams reach over one, two and three of them; some without a token."""
    rng = random.Random(seed)
    pool = ["a", "b", "c", "delve", "into", "the", "vivid", "Don’t", "1984", "--"]
    rows = [(i, rng.choice(["x", "x", "x", "y", None]), " ".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 1, 2, 3, 8])))) for i in range(n)]
    rows += [(n, "x", "It is not just a tool. It is a way. a"), (n + 1, "x", "b"), (n + 2, "x", "c"), (n + 3, "z", None), (n + 4, "z", ""), (n + 5, "w", "!!"), (n + 6, "v", "c")]
    return rows + [rows[7], rows[7]]


def joined(rows, group, least):
    """In order of id, equal rows in any."""
    return "\n\n".join(t for i, g, t in sorted(rows, key=lambda r: r[0]) if g == group and len(t or "") > least)


@pytest.mark.parametrize("parts", [1, 6])
@pytest.mark.parametrize("least", [0, 3])
def test_joined_hits(spark, parts, least):
    rows = outputs()
    df = spark.createDataFrame(rows, "id long, g string, t string").repartition(parts)
    got = {}
    for r in corpus_score.joined_hits(df, "g", "t", ["id"], known(spark), least).collect():
        got.setdefault(r["g"], Counter())[r["kind"], r["phrase"]] = r["hits"]
    want = {g: hits(joined(rows, g, least)) for g in {r[1] for r in rows}}
    assert got == {g: c for g, c in want.items() if c}
    assert sum(n for (kind, _), n in want["x"].items() if kind == "trigram") > sum(n for i, g, t in rows if g == "x" and len(t) > least for (kind, _), n in hits(t).items() if kind == "trigram")


def score(words, trigrams, contrasts):
    out = 0.0
    for kind, value, weight in (("words", words, 60), ("contrast", contrasts, 25), ("trigrams", trigrams, 15)):
        low, high = patterns.SCORE_RANGES[kind]
        out += weight * min(1.0, max(0.0, (value - low) / (high - low)))
    return out


def test_joined_scores(spark):
    rows = outputs()
    df = spark.createDataFrame(rows, "id long, g string, t string").repartition(5)
    got = {r["g"]: r for r in corpus_score.joined_scores(df, "g", "t", ["id"], known(spark), 0).collect()}
    assert set(got) == {r[1] for r in rows}
    for g, r in got.items():
        text, mine = joined(rows, g, 0), [t for _, h, t in rows if h == g]
        found, n = hits(text), len(tokens(text))
        by_kind = {k: sum(c for (kind, _), c in found.items() if kind == k) for k in corpus_score.KINDS}
        contrasts = sum(len(spans.contrasts(t)) for t in mine if t)
        assert (r["samples"], r["valid"], r["chars"], r["tokens"]) == (len(mine), sum(bool(t) for t in mine), len(text), n)
        assert (r["word_hits"], r["trigram_hits"], r["contrast_hits"]) == (by_kind["word"], by_kind["trigram"], contrasts)
        per = lambda a, b: 1000.0 * a / b if b else 0.0
        assert r["score"] == pytest.approx(score(per(by_kind["word"], n), per(by_kind["trigram"], n), per(contrasts, len(text))) if text else 0.0)
    assert got["x"]["contrast_hits"] == 1 and got["z"]["score"] == 0.0


def test_words_and_trigrams_are_those_of_the_plain_functions(spark):
    from pyspark.sql import functions as F

    from tessera.functions import text

    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("ab'’ -é1Z") for _ in range(rng.randint(0, 60)))) for i in range(400)] + [(400, None), (401, "")]
    df = spark.createDataFrame(rows, "id long, t string")
    words, plain = corpus_score._words(F.col("t")), text.benchmark_tokens(F.col("t"))
    got = df.select(words.alias("a"), plain.alias("b"), corpus_score._trigrams(words).alias("c"), text.ngrams(plain, 3).alias("d")).collect()
    assert all(r["a"] == r["b"] and (r["c"] or []) == r["d"] for r in got) and sum(len(r["d"]) for r in got) > 400


def test_output_scores(spark):
    rows = [(1, "delve into the delve"), (2, None), (3, ""), (4, "It is not just a tool. It is a way."), (5, "a b c a b")]
    got = {r["id"]: r for r in corpus_score.output_scores(spark.createDataFrame(rows, "id long, t string"), "id", "t", known(spark)).collect()}
    assert {i: (r["tokens"], r["word_hits"], r["trigram_hits"], r["contrast_hits"]) for i, r in got.items()} == {1: (4, 2, 1, 0), 2: (0, 0, 0, 0), 3: (0, 0, 0, 0), 4: (10, 0, 0, 1), 5: (5, 0, 2, 0)}
    assert got[2]["score"] == 0.0 == got[3]["score"]
    assert got[1]["score"] == pytest.approx(score(500.0, 250.0, 0.0)) and got[4]["score"] == pytest.approx(score(0.0, 0.0, 1000.0 / 35))


def test_top_hits_and_first_contrasts(spark):
    df = spark.createDataFrame([("g", "word", p, n) for p, n in (("a", 2), ("b", 5), ("c", 2), ("d", 1))], "g string, kind string, phrase string, hits long")
    assert [tuple(r)[2:] for r in corpus_score.top_hits(df, "g", 3).orderBy("rank").collect()] == [("b", 5, 1), ("a", 2, 2), ("c", 2, 3)]
    rows = [(2, "g", "It is not just a tool. It is a way."), (1, "g", "So. It was not just a cup. It was a bowl."), (3, "g", None), (4, "g", "none here")]
    got = corpus_score.first_contrasts(spark.createDataFrame(rows, "id long, g string, t string"), "g", "t", ["id"], 100, 0).orderBy("rank").collect()
    want = [(name, hit) for t in (rows[1][2], rows[0][2]) for name, _, _, hit in spans.contrasts(t)]
    assert [(r["pattern"], r["match"]) for r in got] == want and len(want) == 2
    assert corpus_score.first_contrasts(spark.createDataFrame(rows, "id long, g string, t string"), "g", "t", ["id"], 1, 0).count() == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, g string, t string")
    assert corpus_score.joined_scores(df, "g", "t", ["id"], known(spark)).collect() == []
    assert corpus_score.joined_hits(df, "g", "t", ["id"], known(spark)).collect() == []
    assert corpus_score.output_scores(df, "id", "t", known(spark)).collect() == []
