"""Batch top-k codes, gradients and training against plain numpy over whole batches."""

import numpy as np
import pytest

from tessera.operators import latents, sparse_codes
from tessera.operators.sparse_codes import Cut, Model


@pytest.fixture(scope="module", autouse=True)
def shared(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


def model(dims=5, size=12, seed=1):
    rng = np.random.default_rng(seed)
    m = sparse_codes.started(dims, size, seed)
    return Model(m.encoder + rng.normal(0, 0.1, m.encoder.shape), rng.normal(0, 0.1, size), m.decoder, rng.normal(0, 0.1, dims))


def vectors(n=60, dims=5, seed=2):
    return np.random.default_rng(seed).normal(0, 1, (n, dims))


def frame(spark, x, parts=3):
    return spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "id long, v array<double>").repartition(parts)


def coded(spark, x, m, k, parts=3):
    got = sparse_codes.encode(frame(spark, x, parts), "id", "v", m, k).collect()
    out = np.zeros((len(x), len(m.encoder)))
    for r in got:
        out[r["item"], r["ids"]] = r["values"]
    return out


@pytest.mark.parametrize("k", [1, 2, 4, 12])
def test_codes_are_the_largest_of_the_whole_table(spark, k):
    x, m = vectors(), model()
    dense = np.maximum(x @ m.encoder.T + m.encoder_bias, 0).astype(np.float32)
    keep = min(len(x) * k, int((dense > 0).sum()))
    want = np.where(dense >= np.sort(dense.ravel())[::-1][keep - 1], dense, 0)
    assert np.unique(dense[dense > 0]).size == (dense > 0).sum()
    for parts in (1, 5):
        np.testing.assert_array_equal(coded(spark, x, m, k, parts), want)


def test_exactly_so_many_stay_where_the_last_value_is_repeated(spark):
    x, m = np.repeat(vectors(1), 40, axis=0), model()
    dense = np.maximum(x @ m.encoder.T + m.encoder_bias, 0).astype(np.float32)
    levels = np.unique(dense[0][dense[0] > 0])[::-1]
    assert len(levels) > 3
    # 40 rows a level: 2 * 40 end with a level, and one row of another vector makes them end within one.
    extra = np.vstack([x, np.full((1, 5), 0.0)])
    for parts in (1, 4):
        got = coded(spark, extra, m, 2, parts)
        assert (got > 0).sum() == 82
        assert set(np.unique(got[:40][got[:40] > 0])) <= {float(v) for v in levels}
        kept_last = coded(spark, extra, m, 2, 1)
        np.testing.assert_array_equal(got, kept_last)


def test_error_is_that_of_the_reconstruction(spark):
    x, m = vectors(20), model()
    codes = coded(spark, x, m, 2)
    want = ((x - codes @ m.decoder - m.decoder_bias) ** 2).mean(axis=1)
    got = {r["item"]: r["error"] for r in sparse_codes.encode(frame(spark, x), "id", "v", m, 2).collect()}
    np.testing.assert_allclose([got[i] for i in range(20)], want)


def test_rows_without_a_usable_vector(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [1.0, float("nan")]), (5, [float("inf"), 0.0]), (6, [1.0]), (None, [2.0, 1.0]), (7, [0.0, 0.0]), (8, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "id long, v array<float>, ids string")
    m, log = sparse_codes.train(df, "id", "v", latents=4, k=1, steps=2)
    assert [e["rows"] for e in log] == [3, 3]
    got = {r["item"]: r for r in sparse_codes.encode(df, "id", "v", m, 1).collect()}
    assert set(got) == {i for i, _ in rows}
    assert all(got[i]["ids"] == [] and got[i]["error"] is None for i in (2, 3, 4, 5, 6, 8))
    assert all(got[i]["error"] is not None for i in (1, None, 7))


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, v array<double>")
    with pytest.raises(ValueError):
        sparse_codes.train(df, "id", "v", latents=4, k=1)
    assert sparse_codes.encode(df, "id", "v", model(), 1).collect() == []


def loss(parts, x, kept, spare_kept, weight):
    """The loss with the choice of codes held fixed; what is left counts as fixed for dead latents, so only their part of it moves."""
    m = Model(*parts)
    dense = np.maximum(x @ m.encoder.T + m.encoder_bias, 0)
    left = x - (dense * kept) @ m.decoder - m.decoder_bias
    return (left**2).mean(), lambda fixed: weight * (((dense * spare_kept) @ m.decoder - fixed) ** 2).mean(), left


def test_gradients_are_those_of_the_loss():
    x, m, weight = vectors(8), model(), 0.25
    ties = sparse_codes._ties(np.arange(8, dtype=np.int64), 12)
    dead = np.arange(12) % 3 == 0
    value = np.float32(0.4).view(np.uint32)
    cut = Cut((int(value >> 16), int(value & 0xFFFF)))
    dense = m.dense(x)
    kept, spare_kept = cut.kept(dense, ties, np.ones(12, bool)), Cut().kept(dense, ties, dead)
    got, squares, active = sparse_codes.gradients(x, ties, m, cut, float(x.size), Cut(), dead, weight)
    base, _, fixed = loss(m.parts(), x, kept, spare_kept, weight)
    assert squares / x.size == pytest.approx(base, rel=1e-6)
    np.testing.assert_array_equal(active, kept.sum(axis=0))
    step = 1e-5
    for p, part in enumerate(m.parts()):
        for at in np.ndindex(part.shape):
            ends = []
            for sign in (1, -1):
                moved = [q.copy() for q in m.parts()]
                moved[p][at] += sign * step
                main, spare, _ = loss(moved, x, kept, spare_kept, weight)
                ends.append(main + spare(fixed))
            assert got[p][at] == pytest.approx((ends[0] - ends[1]) / (2 * step), abs=1e-6)


def sparse_data(n=600, dims=8, size=6, seed=3):
    rng = np.random.default_rng(seed)
    words = rng.normal(0, 1, (size, dims))
    return (rng.random((n, size)) < 0.25) * rng.uniform(0.5, 1.5, (n, size)) @ words


def test_training_lowers_the_error_and_keeps_decoders_at_unit_length(spark):
    df = frame(spark, sparse_data())
    m, log = sparse_codes.train(df, "id", "v", latents=16, k=3, steps=30, batch_rows=200, parts=2, rate=3e-2, spare_k=2)
    assert np.mean([e["error"] for e in log[-5:]]) < 0.5 * log[0]["error"]
    assert all(e["active"] <= 3 for e in log) and sum(e["rows"] for e in log[:3]) == 600
    np.testing.assert_allclose(np.linalg.norm(m.decoder, axis=1), 1.0)


def test_training_does_not_depend_on_the_splits(spark):
    x = sparse_data(200)
    one, other = (sparse_codes.train(frame(spark, x, parts), "id", "v", latents=8, k=2, steps=4, batch_rows=100)[0] for parts in (1, 7))
    for a, b in zip(one.parts(), other.parts(), strict=True):
        np.testing.assert_allclose(a, b, atol=1e-9)


def test_sample_is_bounded(spark):
    _, log = sparse_codes.train(frame(spark, sparse_data(600)), "id", "v", latents=8, k=2, steps=2, batch_rows=100)
    assert 120 < sum(e["rows"] for e in log) < 280


def test_effects_are_falls_of_a_linear_score(spark):
    x, m, w = vectors(20), model(), np.arange(5) - 1.5
    codes = coded(spark, x, m, 2)
    table = sparse_codes.encode(frame(spark, x), "id", "v", m, 2)
    for r in sparse_codes.effects(table, m, w).collect():
        without = codes[r["item"]].copy()
        without[r["latent"]] = 0
        assert r["effect"] == pytest.approx((codes[r["item"]] - without) @ m.decoder @ w)
    found = {r["latent"]: r for r in sparse_codes.latent_effects(table, m, w, 4).collect()}
    assert set(found) == set(np.argsort(-codes.sum(axis=0), kind="stable")[:4])
    for latent, r in found.items():
        drop = codes[:, latent] * (m.decoder[latent] @ w)
        assert r["mean_effect"] == pytest.approx(drop.mean()) and r["positive_rate"] == (drop > 0).mean() and r["active_rows"] == (codes[:, latent] > 0).sum()
    assert [r["latent"] for r in sorted(found.values(), key=lambda r: r["rank"])] == sorted(found, key=lambda j: -found[j]["mean_effect"])


def test_codes_feed_the_statistics_of_latents(spark):
    table = sparse_codes.encode(frame(spark, vectors(20)), "id", "v", model(), 2)
    assert latents.exploded(table, ["item"], "ids", "values").count() == 40
