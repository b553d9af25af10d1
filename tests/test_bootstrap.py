"""Bootstraps of fixed size: sums of counts, moments, and draws that don't follow from the splits of the input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import bootstrap


@pytest.fixture(scope="module", autouse=True)
def shared(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


def table(spark, n=300):
    x = [("a", i, float(i % 7), i % 3) for i in range(n)] + [("b", i, 1.0, 1) for i in range(5)] + [(None, None, 2.0, None), (None, None, 3.0, 4)]
    return spark.createDataFrame(x, "cell string, doc long, hits double, tokens long").withColumn("replicate", F.lit("clash"))


def values(df):
    return {(r["cell"], r["replicate"]): (r["draws"], r["ones"], r["hits"]) for r in df.collect()}


def test_counts_add_up_and_other_splits_draw_alike(spark, monkeypatch):
    df = table(spark).withColumn("ones", F.lit(1))
    clusters = df.groupBy("cell", "doc").agg(F.sum("hits").alias("hits"), F.max("ones").alias("ones"))
    draw = lambda d, **k: values(bootstrap.redrawn(d, ["cell"], "doc", ["ones", "hits"], 30, leaf=8, **k))
    got = draw(clusters)
    assert len(got) == 90
    for (cell, _), (draws, ones, hits) in got.items():
        assert draws == ones == {"a": 300, "b": 5, None: 1}[cell]
        assert cell == "a" or hits == {"b": 5.0, None: 5.0}[cell]  # two rows of one cluster are one cluster
    assert draw(clusters.repartition(7, "hits")) == got
    assert draw(clusters, seed=14) != got
    monkeypatch.setattr(bootstrap, "FEW_CELLS", 0)
    assert draw(clusters) == got


@pytest.mark.parametrize("leaf", [4, 4096])
def test_moments_are_multinomial(spark, leaf):
    n, replicates = 60, 4000
    df = spark.createDataFrame([("x", i, float(i)) for i in range(n)], "cell string, doc long, v double")
    one = [F.when(F.col("doc") == i, 1).otherwise(0).alias(f"c{i}") for i in range(3)]
    got = bootstrap.redrawn(df.select("*", *one), ["cell"], "doc", ["v", "c0", "c1", "c2"], replicates, leaf=leaf).toPandas()
    assert (got["draws"] == n).all()
    v, spread = np.arange(n), got["v"].to_numpy() / n
    assert abs(spread.mean() - v.mean()) < 5 * v.std() / np.sqrt(n * replicates)
    assert spread.var() == pytest.approx(v.var() / n, rel=0.15)
    for c in ("c0", "c1", "c2"):
        assert got[c].mean() == pytest.approx(1, abs=0.08) and got[c].var() == pytest.approx(1 - 1 / n, rel=0.15)
    # Counts of two clusters hinder each other a little: covariance -1/n.
    assert abs(np.cov(got["c0"], got["c1"])[0, 1] + 1 / n) < 5 / np.sqrt(replicates)


def test_leaves_hold_every_cluster_once(spark):
    made = bootstrap.leaves(table(spark, 500), ["cell"], "doc", ["hits"], 16).where("cell = 'a'").collect()
    assert len(made) > 8 and sum(len(r["_rows"]) for r in made) == 500
    for r in made:
        path = r["_path"]
        assert path[0]["size"] == 500 and path[-1]["size"] == len(r["_rows"])
        for node, child in zip(path, path[1:], strict=False):
            assert child["prefix"] >> 1 == node["prefix"]
            assert child["size"] == (node["size"] - node["left"] if child["prefix"] % 2 else node["left"])


def test_empty_and_wrong(spark):
    assert bootstrap.redrawn(table(spark).where("false"), ["cell"], "doc", ["hits"]).count() == 0
    with pytest.raises(ValueError):
        bootstrap.redrawn(table(spark), ["cell"], "doc", [])


def test_difference_is_conservative(spark):
    low, high = bootstrap.difference(F.lit(1.0), F.lit(3.0), F.lit(0.5), F.lit(0.75))
    assert tuple(spark.range(1).select(low, high).first()) == (0.25, 2.5)
