"""Unions of intervals and blocks of contrasts against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import intervals


@pytest.fixture(scope="module", autouse=True)
def shared(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.mark.parametrize("seed", range(3))
def test_union_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None]), lo, lo + rng.randint(-1, 6), rng.choice("xyz")) for lo in (rng.randint(0, 80) for _ in range(60))] + [("a", None, 3, "x"), ("a", 3, None, "x")] + [("c", 1, 9, "x")] * 3
    want = []
    for k in {r[0] for r in rows}:
        mine = sorted((lo, hi, t) for key, lo, hi, t in rows if key == k and lo is not None and hi is not None and lo <= hi)
        blocks = []
        for lo, hi, t in mine:
            if blocks and lo <= blocks[-1][2]:
                blocks[-1][2] = max(blocks[-1][2], hi)
                blocks[-1][3] += 1
            else:
                blocks.append([k, lo, hi, 1, t])
        want += blocks
    df = spark.createDataFrame(rows, "k string, lo int, hi int, t string").withColumn("n", F.lit("clash"))
    got = intervals.union(df, ["k"], "lo", "hi", ["t"]).collect()
    assert sorted(map(str, (list(r) for r in got))) == sorted(map(str, want))
    assert intervals.union(df.where("false"), ["k"], "lo", "hi").count() == 0


def test_one_key_has_many_runs(spark):
    """Adaptive execution joins small runs; without it each key's intervals lie in several."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        chain = [("k", i, i + 1) for i in range(200)] + [("k", 300 + 3 * i, 301 + 3 * i) for i in range(100)] + [("l", 0, 1)]
        df = spark.createDataFrame(chain, "k string, lo int, hi int")
        got = sorted(tuple(r) for r in intervals.union(df, ["k"], "lo", "hi").collect())
        assert got == sorted([("k", 0, 200, 200), ("l", 0, 1, 1)] + [("k", 300 + 3 * i, 301 + 3 * i, 1) for i in range(100)])
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def verbs(text):
    """Tags words in -ing."""

    @F.udf("array<struct<start: int, end: int, tag: string>>")
    def tag(t):
        import re

        return [(m.start(), m.end(), "VERB") for m in re.finditer(r"\w+ing\b", t or "")]

    return tag(text)


def test_blocks_of_sentences(spark):
    surface = "Hello there. It is not a test, but a song. Done now."
    mixed = "Intro! Not just singing. *Dancing. It was not a tree, but a house. End. Not just humming. *Buzzing."
    docs = spark.createDataFrame([(1, surface), (2, mixed), (3, ""), (4, None), (5, "Nothing here."), (None, surface)], "doc int, t string").withColumn("n", F.lit(0))
    plain = {r["doc"]: r for r in intervals.contrast_blocks(docs, "doc", "t").collect()}
    assert set(plain) == {1, 2, None}
    r = plain[1]
    assert (r["low"], r["high"]) == (1, 1) and surface[r["block_start"] : r["block_end"]].strip() == "It is not a test, but a song."
    assert r["match"] in surface and plain[None]["match"] == r["match"]
    tagged = intervals.contrast_blocks(docs.where("doc = 2"), "doc", "t", verbs, {"gerunds": r"not\s+just\s+VERB[.!?]\s+\*?VERB"}).orderBy("low").collect()
    first, last = tagged[0], tagged[-1]
    assert (first["low"], first["name"], first["match"]) == (1, "gerunds", "Not just singing. *Dancing")
    assert (last["low"], last["high"], last["match"]) == (5, 6, "Not just humming. *Buzzing")
    assert mixed[last["block_start"] : last["block_end"]].strip() == "Not just humming. *Buzzing."


def test_places_go_back_through_tags():
    text = "é was singing and dancing"
    tags = [{"start": 6, "end": 13, "tag": "VERB"}, {"start": 18, "end": 25, "tag": "VERB"}]
    stream, starts, raw = intervals._stream(text, tags)
    assert stream == "é was VERB and VERB"
    at = lambda s: text[slice(*intervals._back(starts, raw, stream.index(s), stream.index(s) + len(s)))]
    assert (at("was VERB"), at("ERB an"), at("and"), at("d VERB")) == ("was singing", "singing an", "and", "d dancing")
