import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import spans
from tessera.operators import annotation, joins, latents, rates, sampling, spectrum, stats, style


@pytest.fixture(scope="module", autouse=True)
def shared(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


def test_sign_test():
    assert stats.sign_test_p(5, 1) == pytest.approx(0.21875) and stats.sign_test_p(0, 0) == 1.0 and stats.sign_test_p(3, 3) == 1.0
    assert stats.sign_test_p(3000, 2000) < 1e-40


def test_false_discovery_equals_the_loop(spark):
    rng = random.Random(2)
    ps = [rng.choice([0.001, 0.01, 0.04, 0.2, 0.2, rng.random()]) for _ in range(40)]
    got = {r["i"]: r["q_value"] for r in stats.false_discovery(spark.createDataFrame(list(enumerate(ps)), "i int, p_value double")).collect()}
    low, want = 1.0, {}
    for rank, i in reversed(list(enumerate(sorted(range(40), key=lambda i: ps[i]), 1))):
        low = min(low, ps[i] * 40 / rank)
        want[i] = low
    assert all(got[i] == pytest.approx(want[i]) for i in want if not any(ps[i] == ps[j] and i != j for j in want))
    assert all(got[i] <= want[i] + 1e-12 for i in want)


def test_spearman(spark):
    rows = [("x", 1.0, 5.0), ("x", 2.0, 6.0), ("x", 2.0, 7.0), ("x", 4.0, 7.5), ("y", 1.0, 1.0), ("z", 1.0, 3.0), ("z", 1.0, 4.0), ("x", None, 1.0)]
    got = {r["g"]: r["spearman"] for r in stats.spearman(spark.createDataFrame(rows, "g string, a double, b double"), "a", "b", ["g"]).collect()}
    assert got["x"] == pytest.approx(np.corrcoef([1, 2.5, 2.5, 4], [1, 2, 3, 4])[0, 1]) and got["y"] is None and got["z"] is None


def test_logit_is_at_its_optimum():
    rng = np.random.default_rng(1)
    x, n = rng.normal(size=200), rng.normal(size=200) * 3 + 50
    y = (x + rng.normal(size=200) > 0).astype(float)
    coef, error, z, odds, length, steps, done = stats.length_adjusted_logit(x, n, y)
    assert done and steps < 15 and coef > 1 and z == pytest.approx(coef / error) and odds == pytest.approx(math.exp(coef)) and abs(length) < 1
    flat = stats.length_adjusted_logit(np.ones(4), np.ones(4), np.array([1.0, 1.0, 0.0, 0.0]))
    assert flat[0] == 0 and flat[6]


def test_bootstrap_is_repeatable_and_covers(spark):
    rng = random.Random(5)
    rows = [("c", i, rng.randint(0, 4), 10) for i in range(400)]
    df = spark.createDataFrame(rows, "cell string, doc int, hits long, tokens long")
    run = lambda d: stats.intervals(stats.resampled(d, ["cell"], "doc", ["hits", "tokens"], 200).withColumn("rate", F.col("hits") / F.col("tokens")), ["cell"], ["rate"]).first()
    a, b = run(df), run(df.repartition(5))
    rate = sum(r[2] for r in rows) / 4000
    assert a == b and a["rate_low"] < rate < a["rate_high"] and a["rate_high"] - a["rate_low"] < 0.06


def test_kappa(spark):
    rows = [("yes", "yes")] * 4 + [("yes", "no")] * 1 + [("no", "no")] * 5
    assert stats.kappa(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()["kappa"] == pytest.approx((0.9 - (5 * 4 + 5 * 6) / 100) / (1 - 0.5))
    assert stats.kappa(spark.createDataFrame([("x", "x")] * 3, "a string, b string"), "a", "b").first()["kappa"] == 1.0


def test_reservoir_equals_sorting(spark):
    rows = [(i, f"id{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "row_index long, id string")
    got = sampling.hash_reservoir(df, sampling.sample_key("blake2b", 7, "s", None, F.col("id")), 5, "row_index").collect()
    want = sorted((spans.blake64(7, "s", "", f"id{i}"), i) for i in range(50))[:5]
    assert [(r["sample_key"], r["row_index"]) for r in got] == want and len(got[0]["sample_key"]) == 16
    other = sampling.hash_reservoir(df, sampling.sample_key("blake2b", 8, "s", None, F.col("id")), 5, "row_index").collect()
    assert [r["id"] for r in other] != [r["id"] for r in got]
    assert [r["row_index"] for r in sampling.first_rows(df, "row_index", 3, 2).collect()] == [0, 1]


@pytest.mark.parametrize("few", [0, 20, 1_000_000])
def test_greedy_removal_equals_the_sequential_loop(spark, few):
    rng = random.Random(4)
    edges = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(70)} | {(i, i + 1) for i in range(40, 50)})
    kept = set()
    for i in range(60):
        if not any(j in kept for a, b in edges for j in ((a,) if b == i else ())):
            kept.add(i)
    items = spark.createDataFrame([(i,) for i in range(60)], "i long")
    got = sampling.greedy_first_wins(items, spark.createDataFrame([(a, b, 1.0) for a, b in edges], "a long, b long, similarity double"), "i", "i", few)
    assert {r["i"] for r in got.collect()} == kept


def test_long_chains_are_settled(spark):
    items = spark.range(71).withColumnRenamed("id", "i")
    edges = spark.range(70).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(1.0).alias("similarity"))
    for few in (5, 1_000_000):
        assert {r["i"] for r in sampling.greedy_first_wins(items, edges, "i", "i", few).collect()} == set(range(0, 71, 2))


def test_edges_equal_all_pairs_of_signatures(spark):
    """Every pair that shares a band and reaches the estimate, between the least items of equal signatures, and each other item with its least one."""
    rng = random.Random(3)
    rows = []
    for f in range(12):
        base = [f"w{rng.randint(0, 40)}" for _ in range(40)]
        for k in range(rng.randint(1, 5)):
            rows.append((len(rows), " ".join([*base[: 40 - k // 2], *["x"] * (k % 2)])))
    rows.append((len(rows), ""))
    signs = {i: [min(spans.blake64(seed, s) for s in spans.shingles(t)) for seed in range(64)] if t else [] for i, t in rows}
    least, want = {}, {}
    for i, sign in signs.items():
        least.setdefault(tuple(sign), i)
    for a in signs:
        for b in signs:
            same = [x == y for x, y in zip(signs[a], signs[b], strict=False)]
            told = least[tuple(signs[a])] == a and (least[tuple(signs[b])] == b or signs[a] == signs[b])
            if a < b and told and same and sum(same) / 64 >= 0.85 and any(all(same[k : k + 4]) for k in range(0, 64, 4)):
                want[a, b] = sum(same) / 64
    got = sampling.near_duplicate_edges(spark.createDataFrame(rows, "i long, t string"), "i", "t").collect()
    assert {(r["a"], r["b"]): r["similarity"] for r in got} == pytest.approx(want) and len(got) == len(want) > 5


def test_equal_texts_make_no_pairs_among_themselves(spark):
    rows = [(i, "one two three four five six seven eight") for i in range(3000)] + [(3000, None), (3001, "x"), (3002, "x")]
    df = spark.createDataFrame(rows, "i long, t string")
    assert {(r["a"], r["b"], r["similarity"]) for r in sampling.near_duplicate_edges(df, "i", "t").collect()} == {(0, i, 1.0) for i in range(1, 3000)} | {(3001, 3002, 1.0)}
    assert sorted(r["i"] for r in sampling.without_near_duplicates(df, "i", "t", "i").collect()) == [0, 3000, 3001]


def test_near_duplicates_removed_equals_the_loop(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(25):
        base = [f"w{rng.randint(0, 30)}" for _ in range(60)]
        for _ in range(rng.randint(1, 6)):
            copy = [*base]
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                copy[rng.randrange(60)] = f"y{rng.randint(0, 99)}"
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    rows = [(i, rng.randint(0, 40), t) for i, t in enumerate([*rows, "", "a b"])]
    signs = {i: [min(spans.blake64(seed, s) for s in spans.shingles(t)) for seed in range(64)] if spans.shingles(t) else [] for i, _, t in rows}
    kept = []
    for _, i in sorted((o, i) for i, o, _ in rows):
        same = [[x == y for x, y in zip(signs[i], signs[k], strict=True)] for k in kept if signs[i] and signs[k]]
        if not any(sum(s) / 64 >= 0.85 and any(all(s[b : b + 4]) for b in range(0, 64, 4)) for s in same):
            kept.append(i)
    got = sampling.without_near_duplicates(spark.createDataFrame(rows, "i long, o long, t string"), "i", "t", "o").collect()
    assert sorted(r["i"] for r in got) == sorted(kept) and len(kept) < len(rows) - 10


@pytest.mark.parametrize("run", [7, 100_000])
def test_overall_ranks_and_discovery_equal_loops(spark, monkeypatch, run):
    monkeypatch.setattr(stats, "RUN", run)
    rng = random.Random(2)
    values = [rng.randint(0, 20) / 20 for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(values)), "i long, p_value double").repartition(5)
    ranks = {r["i"]: r["k"] for r in stats.with_average_rank(df, "p_value", "k").collect()}
    assert ranks == {i: 1 + sum(x < v for x in values) + (values.count(v) - 1) / 2 for i, v in enumerate(values)}
    q = {r["i"]: r["q_value"] for r in stats.false_discovery(df).collect()}
    order = sorted(values)
    want = {v: min(1.0, min(x * 60 / (k + 1) for k, x in enumerate(order) if x >= v)) for v in values}
    assert q == pytest.approx({i: want[v] for i, v in enumerate(values)})


def test_logit_of_groups_equals_that_of_one(spark):
    rng = np.random.default_rng(6)
    rows = []
    for g, n in (("a", 40), ("b", 25), ("flat", 5)):
        for _ in range(n):
            x = rng.normal(1, 1, 2) if g != "flat" else np.ones(2)
            rows.append((g, float(x[0] + 0.5), float(x[1]), int(rng.integers(5, 90)), int(rng.integers(5, 90))))
    df = spark.createDataFrame(rows, "g string, chosen_rate_per_1k_tokens double, rejected_rate_per_1k_tokens double, chosen_tokens long, rejected_tokens long")
    for r in stats.logit_by_group(df.repartition(3), ["g"]).collect():
        mine = [x for x in rows if x[0] == r["g"]]
        want = stats.length_adjusted_logit(np.array([x[1] for x in mine] + [x[2] for x in mine]), np.array([x[3] for x in mine] + [x[4] for x in mine], float), np.repeat([1.0, 0.0], len(mine)))
        assert tuple(r)[1:] == pytest.approx(want, rel=1e-6, abs=1e-9)


def test_prompt_samples(spark):
    import hashlib

    df = spark.createDataFrame([(i, f"s{i % 3}", f"id{i}") for i in range(30)], "row_index long, source string, id string")
    want = sorted(range(30), key=lambda i: hashlib.sha256(f"4\0s{i % 3}\0id{i}".encode()).hexdigest())[:6]
    assert [r["row_index"] for r in sampling.prompt_sample(df, "hash", 6, "row_index", "source", "id", 4).collect()] == want
    assert [r["row_index"] for r in sampling.prompt_sample(df, "first", 3, "row_index", "source", "id").collect()] == [0, 1, 2]
    assert sampling.prompt_sample(df, "hash", 0, "row_index", "source", "id").count() == 30


def test_word_lists(spark, tmp_path):
    (tmp_path / "list.txt").write_text("Delve\n\n tapestry \ndon’t\n")
    (tmp_path / "list.json").write_text('[["delve into the", 3.5], "a rich tapestry"]')
    assert sorted(r[0] for r in style.word_list(spark, str(tmp_path / "list.txt")).collect()) == ["delve", "don't", "tapestry"]
    known = style.word_list(spark, str(tmp_path / "list.json"))
    assert sorted(r[0] for r in known.collect()) == ["a rich tapestry", "delve into the"]
    docs = spark.createDataFrame([(1, ["delve into the", "x", "delve into the"]), (2, ["y"]), (3, [])], "i long, g array<string>")
    assert sorted(map(tuple, style.list_hits(docs, "i", "g", known).collect())) == [(1, 2), (2, 0), (3, 0)]


def test_near_duplicate_edges(spark):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(1, base), (2, base + " more"), (3, "something else entirely " * 5), (4, base.upper())]
    got = {(r["a"], r["b"]) for r in sampling.near_duplicate_edges(spark.createDataFrame(rows, "i long, t string"), "i", "t", 0.8).collect()}
    assert (1, 4) in got and (1, 2) in got and not any(3 in e for e in got)


def test_budget_shards(spark):
    rows = [("a", i, n) for i, n in enumerate([5, 5, 5, 20, 1, 9, 1])]
    got = sampling.budget_shards(spark.createDataFrame(rows, "g string, i int, n long"), "i", "n", 10, ["g"]).orderBy("i").collect()
    assert [r["shard"] for r in got] == [0, 0, 1, 2, 3, 3, 4]


def test_range_join_equals_loops(spark):
    rng = random.Random(1)
    points, spans_ = [(i, rng.randint(-50, 200)) for i in range(80)], [(i, a, a + rng.randint(0, 60)) for i, a in enumerate(rng.choices(range(-60, 180), k=30))]
    got = joins.ranges(spark.createDataFrame(points, "p int, x long"), spark.createDataFrame(spans_, "s int, lo long, hi long"), "x", "lo", "hi", 16)
    assert {(r["p"], r["s"]) for r in got.collect()} == {(p, s) for p, x in points for s, lo, hi in spans_ if lo <= x < hi}
    assert got.count() == len({(r["p"], r["s"]) for r in got.collect()})


def test_checks_raise(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert joins.one_to_one(a, a.withColumnRenamed("v", "w"), ["k"]).count() == 2
    for bad in (a.where("k = 1"), a.union(a.where("k = 1"))):
        with pytest.raises(Exception, match="partner|repeated"):
            joins.one_to_one(a, bad.withColumnRenamed("v", "w"), ["k"]).collect()
    with pytest.raises(ValueError, match="missing columns"):
        joins.require_columns(a, ["k", "z"])
    pairs = annotation.met(a.withColumn("feature", F.lit("f")), a, "k", "v")
    assert pairs.count() == 2
    with pytest.raises(Exception, match="needs none"):
        annotation.adjudicated(pairs, spark.createDataFrame([(1, "z")], "k int, label string"), "k").collect()
    with pytest.raises(Exception, match="changed field"):
        annotation.unblinded(a, a.withColumn("v", F.lit("q")), "k", ["v"]).collect()


def test_paired_roles_by_occurrence(spark):
    rows = [("p", "chosen", 1, "a"), ("p", "chosen", 2, "b"), ("p", "rejected", 3, "c"), ("q", "chosen", 4, "d")]
    got = joins.paired_roles(spark.createDataFrame(rows, "pair string, role string, i int, t string"), ["pair"], "i", "t").collect()
    assert [(r["pair"], r["chosen"], r["rejected"]) for r in got] == [("p", "a", "c")]


def spectrum_rows(feature, factors, **more):
    base = dict(normalized_af=None, af=None, af_low=None, af_high=None, excess=None, realized_af=None, sft_rate=None, chosen_rate=None, rejected_rate=None) | more
    return [(feature, stage, *(base | {"normalized_af": f}).values()) for stage, f in zip(("base", "sft", "dpo", "final"), factors, strict=True)]


def test_classes(spark):
    rows = spectrum_rows("pref", (1.0, 1.1, 1.6, 1.5), chosen_rate=3.0, rejected_rate=1.0) + spectrum_rows("sft", (1.0, 1.4, 1.4, 1.4)) + spectrum_rows("comp", (1.0, 1.0, 1.1, 1.0), excess=0.5, realized_af=1.3, sft_rate=0.9)
    rows += spectrum_rows("inh", (1.0, 0.9, 1.1, 1.2), sft_rate=0.3) + spectrum_rows("none", (0.4, 0.5, 0.4, 0.4)) + spectrum_rows("obs", (None,) * 4) + spectrum_rows("zero", (0.0,) * 4, af=1.3)
    cols = "feature string, stage string, " + ", ".join(f"{c} double" for c in ("normalized_af", "af", "af_low", "af_high", "excess", "realized_af", "sft_rate", "chosen_rate", "rejected_rate"))
    got = {r["feature"]: r for r in spectrum.classify(spark.createDataFrame(rows, cols)).collect()}
    assert {k: r["primary_class"] for k, r in got.items()} == {"pref": "preference-amplified", "sft": "sft-amplified", "comp": "compounding-dominant", "inh": "inherited", "none": "measured-without-class", "obs": "observed-output-only", "zero": "sft-amplified"}
    assert got["pref"]["preference_cause"] == "signal-driven" and got["sft"]["preference_cause"] == "not-preference-amplified"
    weak = spark.createDataFrame([("pref", 9, "chosen_gt_rejected", False)], "feature string, pairs long, direction string, fdr_significant boolean")
    assert {r["feature"]: r["preference_cause"] for r in spectrum.classify(spark.createDataFrame(rows, cols), weak).collect()}["pref"] == "dynamics-driven"


def test_amplification_against_baseline(spark):
    rows = [("a", 1, 0.2), ("a", 0, 0.2), ("b", 1, 0.1), ("b", 0, 0.1)]
    got = {r["feature"]: r for r in rates.amplification(spark.createDataFrame(rows, "feature string, initiates int, prob_mass double"), [], "b").collect()}
    assert got["a"]["normalized_amplification_factor"] == pytest.approx(2.0) and got["b"]["normalized_amplification_factor"] == pytest.approx(1.0)


def test_contexts_and_windows(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"], [0.1, None, 0.9, 0.2])], "t array<string>, v array<double>")
    got = df.select(latents.token_context(F.col("t"), F.col("v"), 1).alias("c")).first()["c"]
    assert [(x["token"], x["value"]) for x in got] == [("b", 0.0), ("c", 0.9), ("d", 0.2)]
    assert spark.createDataFrame([("hello brave world",)], "t string").select(latents.peak_window(F.col("t"), F.lit(6), F.lit(11), 3)).first()[0] == "lo [[brave]] wo"


def keyed(seed, text):
    """What a hash of a whole number and a text is, as a signed number."""
    import xxhash

    first = xxhash.xxh64(seed.to_bytes(4, "little"), seed=42).intdigest()
    h = xxhash.xxh64(text.encode(), seed=first).intdigest()
    return h - (1 << 64) if h >> 63 else h


def test_hash_split_holds_out_whole_bases(spark):
    rows = [(i, f"b{i % 40}") for i in range(120)]
    df = spark.createDataFrame(rows, "i long, b string")
    place = {b: keyed(3, b) % 10_000 for _, b in rows}
    for percent in (0.0, 0.001, 20.0, 100.0):
        want = {b for b, h in place.items() if percent and (h < percent * 100 or h == min(place.values()))}
        got = sampling.hash_split(df, "b", percent, 3).collect()
        assert len(got) == 120 and all(r["held_out"] == (r["b"] in want) for r in got)
        assert (len(want) == 1) == (percent == 0.001)


def test_seeded_shuffle_takes_the_first_of_each_group(spark):
    rows = [(i, f"g{i % 3}") for i in range(50)]
    got = sampling.seeded_shuffle(spark.createDataFrame(rows, "i long, g string"), ["g"], "i", 11, 4).collect()
    want = {(g, i) for g in ("g0", "g1", "g2") for i in sorted((i for i, h in rows if h == g), key=lambda i: keyed(11, str(i)))[:4]}
    assert {(r["g"], r["i"]) for r in got} == want and len(got) == 12


def test_ranked_candidates_equal_the_loop(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([-1.0, 0.5, 1.5, 2.5]), rng.choice([0.0, 0.2, 0.96, 1.2]), rng.choice([-2.0, 0.0, 1.0, 3.0]), rng.choice([0.0, 1.0, 7.0])) for i in range(80)]
    got = latents.ranked_candidates(spark.createDataFrame(rows, "latent int, log_odds double, active_token_rate double, effect double, total_mass double"), "effect", 25).orderBy("rank").collect()
    score = lambda r: max(0, r[1]) * max(0, 1 - r[2]) * max(0, r[3]) * math.log1p(r[4])
    order = sorted((r for r in rows if r[4] > 0), key=lambda r: (-score(r), -r[3], -r[1], r[0]))[:25]
    names = lambda r: "broad_or_ubiquitous" if r[2] >= 0.95 else "not_ai_score_positive" if r[3] <= 0 else "high_ai_enrichment" if r[1] >= 2 else "moderate_ai_enrichment" if r[1] >= 1 else "weak_ai_enrichment"
    assert [r["rank"] for r in got] == list(range(1, 26))
    assert [(r["latent"], r["category"]) for r in got] == [(r[0], names(r)) for r in order]
    assert [r["score"] for r in got] == pytest.approx([score(r) for r in order])


def test_only_texts_that_may_be_near_are_signed_whole(spark):
    """Near copies, equal texts and the rest: what stays is what all whole signatures say, and unlike texts have none."""
    rng = random.Random(8)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(5000)], k=80)) for _ in range(30)]
    texts += [t + " more" for t in texts[:6]] + texts[6:9] + [" ".join(t.split()[:20] + rng.choices([f"v{i}" for i in range(5000)], k=60)) for t in texts[9:15]] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    sigs = {r["i"]: r["s"] for r in df.select("i", spans.minhash_function()(F.col("t")).alias("s")).collect()}
    near = lambda a, b: sum(x == y for x, y in zip(sigs[a], sigs[b], strict=True)) / 64 >= 0.85 and any(sigs[a][k : k + 4] == sigs[b][k : k + 4] for k in range(0, 64, 4))
    stay = []
    for i in range(len(texts)):
        if not texts[i] or not any(texts[j] and near(j, i) for j in stay):
            stay.append(i)
    assert sorted(r["i"] for r in sampling.without_near_duplicates(df, "i", "t", "i").collect()) == stay and len(stay) < len(texts) - 6
    signed = {r["item"]: r["sig"] for r in sampling._signed(df, "i", "t", "i", 64, 5, 0.85).collect()}
    assert all(s is None or s == sigs[i] for i, s in signed.items()) and len(signed) == len(texts)
    assert all(signed[i] is not None for i in (0, 30, 6, 36)) and sum(s is not None for s in signed.values()) < 24
