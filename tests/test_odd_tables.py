"""Queries against their SQL on small tables unlike the test tables."""

import duckdb
import pandas as pd

from tessera.plans import catalog


def both(spark, tmp_path, query, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        frame.to_parquet(f"{tmp_path}/{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    got, want = catalog.QUERIES[query](spark, str(tmp_path)).toPandas(), con.sql(catalog.SQL[query]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    return tuple(sorted(map(tuple, f[columns].to_numpy().tolist())) for f in (got, want))


def test_best_parts_with_keys_far_apart(spark, tmp_path):
    """A key that is 200,000 ahead outweighs a tenth in the price; all three brands of a size are needed."""
    rows = [(i * 200_000 + j, f"Brand#{11 + j}", i % 2, 999.9 - i / 10) for i in range(6) for j in range(3)]
    part = pd.DataFrame(rows, columns=["p_partkey", "p_brand", "p_size", "p_retailprice"])
    got, want = both(spark, tmp_path, "j29_in_all", part=part)
    assert got == want and len(got) == 2
    assert "1000000;1000001;1000002" in str(got)
