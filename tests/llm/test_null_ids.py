"""Rows without an id in the n-gram join, against brute force over row numbers."""

import random
from collections import Counter

from tessera.llm import ngram_join

from .fixtures import words
from .test_media_text_models import brute

SCHEMA = "doc_id long, text string"


def test_unrelated_texts_without_ids_all_stay(spark):
    rng = random.Random(2)
    some = [words(rng, 40) for _ in range(5)]
    rows = [(None, t) for t in some] + [(None, some[0])] * 2 + [(1, words(rng, 40)), (2, some[4]), (None, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = [tuple(r) for r in ngram_join.deduplicated(docs).collect()]
    assert Counter(kept) == Counter([*((None, t) for t in some[:4]), (2, some[4]), rows[7], (None, "")])


def test_near_copies_without_ids_are_linked(spark):
    rng = random.Random(3)
    rows = []
    for ids in ((1, None, None), (None, None), (None, 2, 3), (None,)):
        base = words(rng, 60).split()
        for k, i in enumerate(ids):
            t = " ".join([*base[: len(base) - k], *["new"] * k])
            rows += [(i, t)] * (2 if i is None and k else 1)
    classes, links = brute([t for _, t in rows])
    least = {c: min((i for (i, _), d in zip(rows, classes, strict=True) if d == c and i is not None), default=None) for c in classes}
    docs = spark.createDataFrame(rows, SCHEMA)
    out = ngram_join.join(docs).collect()
    h = dict(docs.selectExpr("text", "xxhash64(text)").collect())
    assert Counter((r["doc_id"], r["h"], r["class_id"], r["links"]) for r in out) == Counter((i, h[t], least[c], n) for (i, t), c, n in zip(rows, classes, links, strict=True))
    assert len({r["class_key"] for r in out}) == len(set(classes)) == 4 == ngram_join.deduplicated(docs).count() and max(links) > 1
