"""Whitening against numpy on whole arrays."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.llm import whitening

DATA = "/root/testdata/sf0.001"


def dense(vectors):
    x = np.floor(np.array(vectors, dtype=np.float64) * 64).astype(np.int64) + 1_000_000
    once = np.unique(x, axis=0)
    n, sums = len(once), once.sum(axis=0)
    centred = (once - sums // n) - (sums % n) / n
    values, components = np.linalg.eigh(centred.T @ centred / n)
    return x, n, sums, values[::-1], components.T[::-1]


def agree(rows, vectors, ids, most=16):
    x, n, sums, values, components = dense(vectors)
    k = min(most, x.shape[1])
    assert len(rows) == len(vectors) * k
    by_id = {}
    for r in rows:
        by_id.setdefault(r["vec_id"], []).append(r)
    signs = {}
    for i, v in zip(ids, x, strict=True):
        assert {r["component"] for r in by_id[i]} == set(range(1, k + 1))
        want = (v - sums // n) - (sums % n) / n
        for r in by_id[i]:
            c = r["component"] - 1
            assert r["n"] == n and r["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums, strict=True))
            assert r["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-6) and r["identity_error"] < 1e-6
            value = want @ components[c] / np.sqrt(values[c])
            if abs(value) > 0.01:
                sign = signs.setdefault(c, np.sign(value * r["whitened"]))
                assert r["whitened"] == pytest.approx(sign * value, rel=1e-5, abs=1e-7)


def frame(spark, vectors, ids=None):
    rows = [(i if ids is None else ids[i], v, "x", 1.0) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string, whitened double")


def test_equals_numpy(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(120, 5)) @ rng.normal(size=(5, 5))).tolist()
    vectors += vectors[:1] * 60  # a third of all rows hold one vector
    rows = whitening.whitened(frame(spark, vectors), ["vec_id", "x"]).collect()
    assert {r["x"] for r in rows} == {"x"}
    agree(rows, vectors, range(len(vectors)))
    rows = whitening.whitened(frame(spark, vectors), ["vec_id"], most=2).collect()
    agree(rows, vectors, range(len(vectors)), 2)


def test_more_pairs_than_one_aggregation_holds(spark, monkeypatch):
    monkeypatch.setattr(whitening, "PAIRS_AT_ONCE", 4)
    vectors = np.random.default_rng(2).normal(size=(40, 4)).tolist()
    agree(whitening.whitened(frame(spark, vectors), ["vec_id"]).collect(), vectors, range(40))


def test_rows_that_take_no_part(spark):
    rng = np.random.default_rng(3)
    good = rng.normal(size=(30, 3)).tolist()
    bad = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 0.0, 0.0], [0.0, 0.0, float("-inf")], [1.0, 2.0], [1.0, 2.0, 3.0, 4.0]]
    agree(whitening.whitened(frame(spark, good + bad), ["vec_id"]).collect(), good, range(30))
    nulls = whitening.whitened(frame(spark, good, [None, *range(29)]), ["vec_id"])
    assert nulls.where("vec_id IS NULL").count() == 3


def test_deviation_by_decimals(spark, monkeypatch):
    vectors = (np.random.default_rng(4).normal(size=(25, 3)) * 3e5).tolist()
    df = frame(spark, vectors)
    rows, dims = whitening.gridded(df, "embedding")
    model = whitening.fit(rows.select("x"), dims)
    assert dims * (model.n * model.spread) ** 2 > 1 << 63  # the bound, so decimals are used; the values themselves fit
    agree(whitening.whitened(df, ["vec_id"]).collect(), vectors, range(25))


def test_without_variance(spark):
    one = whitening.whitened(frame(spark, [[0.5, 1.5]] * 4), ["vec_id"]).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, None)] * 8
    flat = whitening.whitened(frame(spark, [[float(i), 2.0 * i] for i in range(6)]), ["vec_id"]).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in flat) and flat[0]["identity_error"] < 1e-9
    assert whitening.whitened(frame(spark, [[1.0]]).where("false"), ["vec_id"]).collect() == []
    assert whitening.whitened(frame(spark, [None, []]), ["vec_id"]).collect() == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_query(spark):
    found = whitening.op11_whitening(spark, DATA)
    assert dict(found.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    ids, vectors = zip(*duckdb.sql(f"SELECT vec_id, embedding FROM '{DATA}/embeddings.parquet'").fetchall(), strict=True)
    agree(found.collect(), vectors, ids)
    assert found.select(F.countDistinct("identity_error")).first()[0] == 1
