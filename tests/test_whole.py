"""Queries over whole texts and all rows, against brute force."""

import math
import os

import duckdb
import pytest

from tessera.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def rows(columns, name):
    return duckdb.sql(f"SELECT {columns} FROM '{DATA}/{name}.parquet'").fetchall()


def test_span_scores_of_whole_documents(spark):
    got = catalog.QUERIES["g05_span_scores"](spark, DATA).toPandas()
    want = {}
    for d, text in rows("doc_id, text", "documents"):
        scores = [float(i % 4) for i in range(len(text.split(" ")))]
        want |= {(d, i, n): sum(scores[i : i + n]) / math.sqrt(n) for n in range(1, 5) for i in range(len(scores) - n + 1)}
    assert len(got) == len(want) and max(i for _, i, _ in want) > 1000
    assert all(abs(want[d, i, n] - s) < 1e-8 for d, i, n, s in zip(got["doc_id"], got["start"], got["length"], got["score"], strict=True))


def test_span_texts(spark):
    from tessera.sources import provider

    tokens = spark.createDataFrame([(1, i, t, float(i)) for i, t in enumerate("abc")], "doc_id long, token_index int, token string, score double")
    got = {(r["start"], r["length"]): r["span"] for r in provider.span_scores(tokens).collect()}
    assert got == {(0, 1): "a", (1, 1): "b", (2, 1): "c", (0, 2): "a b", (1, 2): "b c", (0, 3): "a b c"}


def test_provider_texts_are_whole(spark):
    import hashlib

    got = {r["doc_id"]: r["generated"] for r in catalog.QUERIES["s12_provider_texts"](spark, DATA).collect()}
    texts = dict(rows("doc_id, text", "documents"))
    assert max(map(len, texts.values())) > 300
    assert got == {d: hashlib.md5(t.encode()).hexdigest() for d, t in texts.items()}


@pytest.mark.parametrize("most", [None, 3])
def test_opportunity_function_equals_the_loop(spark, most):
    from tessera.functions import patterns, spans

    features = (*patterns.opportunity_specs(), "none such")
    texts = [None, "", " ", "In the end of the day, of the red, white and blue.\nIn the"] + [t for (t,) in rows("text", "documents")[:150]]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").coalesce(1)
    got = dict(df.select("i", spans.opportunity_function(features, most)("text")).collect())
    for i, t in enumerate(texts):
        assert (None if got[i] is None else [tuple(o) for o in got[i]]) == (None if t is None else spans.opportunities(t, list(features), most))


def test_counted_opportunities_equal_those_found(spark):
    from collections import Counter

    from tessera.functions import patterns, spans

    features = tuple(patterns.opportunity_specs())
    texts = [None, "", "In the end of the day, of the red, white and blue.\nIn the"] + [t for (t,) in rows("text", "documents")[:40]]
    got = dict(spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", spans.opportunity_counts(features)("text")).collect())
    for i, t in enumerate(texts):
        every, initiated = Counter(), Counter()
        for feature, kind, _, initiates, _ in spans.opportunities(t, list(features)) if t is not None else []:
            every[feature, kind] += 1
            initiated[feature, kind] += initiates
        assert (None if got[i] is None else {(c["feature"], c["kind"]): (c["opportunities"], c["initiations"]) for c in got[i]}) == (None if t is None else {k: (n, initiated[k]) for k, n in every.items()})


def test_propensity_contract_takes_every_token_start(spark):
    from tessera.functions import spans

    got = {(r["source"], r["feature"]): r for r in catalog.QUERIES["g01_propensity_contract"](spark, DATA).collect()}
    want = {}
    for source, text in rows("source, text", "documents"):
        for feature, _, _, initiates, _ in spans.opportunities(text, ["neutral_common_of_the", "neutral_common_in_the"]):
            n, k = want.get((source, feature), (0, 0))
            want[source, feature] = n + 1, k + initiates
    assert {k: (r["opportunities"], r["reference_initiations"]) for k, r in got.items()} == want


def test_classifier_tells_held_out_documents(spark):
    labels = dict(rows("doc_id, quality", "labels"))
    got = catalog.QUERIES["g04_text_classifier"](spark, DATA).collect()
    assert len(got) == len(rows("doc_id", "documents"))
    held = [(r["probability"] >= 0.5) == (labels[r["doc_id"]] == 1) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 10 and sum(held) / len(held) > 0.8
