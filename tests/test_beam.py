"""Searches against plain enumeration."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import beam
from tessera.operators import language_model as lm

from .test_language_model import Plain, corpus, frame

TEXTS = corpus(40, 7)
WORDS = ["the", "of", "cat", "sat", "on", ",", "mat", ".", "a", "one"]
PROMPTS = [(1, "The cat"), (2, ""), (3, None), (4, "never seen"), (5, "the never")]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    labelled = spark.createDataFrame([("the the cat on", 0), ("of of sat a", 1), ("mat , .", 2), ("left out", None), (None, 1), ("out", 7)], "text string, b int")
    return lm.fit(frame(spark, TEXTS)), beam.bucket_detector(labelled, "text", "b", 3)


def prompts(spark):
    return spark.createDataFrame(PROMPTS, "id int, text string").withColumn("words", F.lit("clash"))


class Scorer:
    def __init__(self):
        words = [["the", "the", "cat", "on"], ["of", "of", "sat", "a"], ["mat", ",", "."]]
        size = len(set(sum(words, [])))
        self.log = lambda w, b: math.log((words[b].count(w) + 1) / (len(words[b]) + size + 1))
        self.prior = [math.log(2), math.log(3), math.log(2)]

    def __call__(self, words):
        x = [math.exp(self.prior[b] + sum(self.log(w, b) for w in words)) for b in range(3)]
        return (x[1] + 2 * x[2]) / sum(x) / 2


def read(text):
    return [w.lower() for w in lm._TOKEN.findall(text or "")]


def test_likeliest_words_are_exact(spark, made):
    plain = Plain(TEXTS)
    known = beam.followers(made[0], 4)
    some = [("<s>", "<s>"), ("the", "cat"), ("never", "the"), ("x", "never"), *list(plain.after[1])[:15]]
    got = {(r["u"], r["v"]): r["choices"] for r in beam.likeliest(known, spark.createDataFrame(some * 2, "u string, v string")).collect()}
    assert len(got) == len(set(some))
    words = [w for w in plain.one if w in WORDS]
    for (u, v), choices in got.items():
        want = sorted((-round(plain.p(u, v, w), 12), w) for w in words)[:4]
        assert [(round(c["n"], 12), c["w"]) for c in choices] == want


def test_wide_beam_equals_exhaustive_search(spark, made):
    model, detector = made
    plain, scorer = Plain(TEXTS), Scorer()
    found = beam.search(prompts(spark), "id", "text", beam.followers(model, 20), detector, 2, beams=100, branches=20, likelihood=0.3, repetition=0.2, quality=0.5)
    got = {(r["id"], tuple(r["words"])): (r["objective"], r["beam_rank"]) for r in beam.last_beams(found, "id").collect()}
    words = [w for w in plain.one if w in WORDS]
    assert len(got) == len(PROMPTS) * len(words) ** 2
    pairs = list(itertools.product(words, repeat=2))
    penalties = dict(zip(pairs, [r[0] for r in spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(pairs)], "i int, t string").orderBy("i").select(T.quality_penalty(F.col("t"))).collect()], strict=True))
    for i, text in PROMPTS:
        context = ["<s>", "<s>", *read(text)]
        want = {}
        for pair in pairs:
            full = context + list(pair)
            log_p = sum(math.log(plain.p(*full[n - 2 : n + 1])) for n in (len(context), len(context) + 1))
            want[pair] = scorer(read(text) + list(pair)) + 0.3 * log_p / 2 - 0.2 * (2 - len(set(pair))) / 2 - 0.5 * penalties[pair]
        assert {p: got[i, p][0] for p in pairs} == pytest.approx(want, abs=1e-8)
        assert sorted(pairs, key=lambda p: got[i, p][1]) == sorted(pairs, key=lambda p: (-got[i, p][0], p))


def test_narrow_beam_equals_the_loop(spark, made):
    model, detector = made
    plain, scorer = Plain(TEXTS), Scorer()
    words = [w for w in plain.one if w in WORDS]
    found = beam.search(prompts(spark), "id", "text", beam.followers(model, 5), detector, 4, beams=2, branches=3, likelihood=0.3, repetition=0.2)
    got = {}
    for r in found.orderBy("id", "step", "beam_rank").collect():
        got.setdefault((r["id"], r["step"]), []).append(tuple(r["words"]))
    for i, text in PROMPTS:
        states = [((), 0.0)]
        for step in range(1, 5):
            pool = []
            for path, log_p in states:
                full = ["<s>", "<s>", *read(text), *path]
                q = {w: math.log(plain.p(full[-2], full[-1], w)) for w in words}
                top = sorted(words, key=lambda w: (-round(q[w], 12), w))[:5]
                choice = lambda w: scorer(read(text) + [*path, w]) + 0.3 * q[w] - 0.2 * path.count(w)  # noqa: B023, E731
                for w in sorted(top, key=lambda w: (-round(choice(w), 9), w))[:3]:
                    new = (*path, w)
                    total = log_p + q[w]
                    o = scorer(read(text) + list(new)) + 0.3 * total / step - 0.2 * (step - len(set(new))) / step
                    pool.append((-round(o, 9), new, total))
            states = [(p, t) for _, p, t in sorted(pool)[:2]]
            assert got[i, step] == [p for p, _ in states]


def test_stopped_search_goes_on(spark, made, tmp_path):
    model, detector = made
    known, at = beam.followers(model, 5), str(tmp_path / "search")
    run = lambda steps, at=None: sorted(map(str, beam.search(prompts(spark), "id", "text", known, detector, steps, at=at).collect()))
    run(2, at)
    kept = {f: f.stat().st_mtime_ns for f in (tmp_path / "search").rglob("*.parquet")}
    (tmp_path / "search" / "step=3").mkdir()  # a step that was begun and has no end
    assert run(4, at) == run(4)
    assert all(f.stat().st_mtime_ns == t for f, t in kept.items())


def test_samples_are_seeded_and_fair(spark, made):
    model, detector = made
    known = beam.followers(model, 20)
    one = prompts(spark).where("id = 1")
    draw = lambda p, seed=1, n=2, samples=5: sorted(map(str, beam.sampled(p, "id", "text", known, detector, n, samples=samples, seed=seed).collect()))
    assert draw(prompts(spark)) == draw(prompts(spark).repartition(7)) != draw(prompts(spark), 2)
    plain = Plain(TEXTS)
    words = [w for w in plain.one if w in WORDS]
    total = sum(plain.p("the", "cat", w) for w in words)
    n = 4000
    got = {r["w"]: r["count"] for r in beam.sampled(one, "id", "text", known, detector, 1, samples=n).groupBy(F.col("words")[0].alias("w")).count().collect()}
    for w in words:
        p = plain.p("the", "cat", w) / total
        assert abs(got.get(w, 0) / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3


def test_empty(spark, made):
    model, detector = made
    known = beam.followers(model, 3)
    assert beam.search(prompts(spark).where("false"), "id", "text", known, detector, 2).count() == 0
    none = lm.fit(frame(spark, ["x"]).where("false"))
    assert beam.search(prompts(spark), "id", "text", beam.followers(none, 3), detector, 2).count() == 0
    with pytest.raises(ValueError):
        beam.search(prompts(spark), "id", "text", known, detector, 0)
