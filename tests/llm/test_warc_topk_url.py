import base64
import gzip
import hashlib
import json
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.llm import topk, urlfilter, warc
from tessera.llm.common import fresh_dir


def sha(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def odd_pages(spark):
    rng = random.Random(4)
    rows = [(i, f"http://h{i % 5}.example.com/{i}", "".join(rng.choice("abc <>é\n") for _ in range(rng.randint(0, 400)))) for i in range(120)]
    rows += [(200 + i, None, "hot page") for i in range(50)] + [(7, "http://again/", "hot page"), (7, "http://again/", "hot page"), (300, "bad\r\nurl ü", ""), (301, "x", None), (None, "y", "null id"), (None, None, None)]
    rows += [(400, "long", "long text " * 200_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("shard", F.lit("s"))


@pytest.mark.parametrize("least", [0, 9])
@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_archives_read_back(spark, monkeypatch, least, broadcast):
    monkeypatch.setattr(warc, "MOST_BROADCAST", broadcast)
    monkeypatch.setattr(warc, "RUN", 3)
    pages = odd_pages(spark)
    folder = fresh_dir(spark, "warc")
    totals = warc.write_warc(pages, folder, least_payload=least, shard_bytes=1 << 20, roll_bytes=3000)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).collect()
    back = warc.read_warc(spark, folder, with_payload=True).collect()
    assert totals["records"] == len(rows) == len(back) and totals["files"] > totals["shards"] > 1
    order = lambda r: (r["page_id"] is None, r["page_id"] or 0, r["url"] is None, r["url"] or "")
    first, want = {}, []
    for r in sorted(rows, key=order):
        data = r["html"].encode()
        again = len(data) >= least and data in first
        first.setdefault(data, r["page_id"])
        want.append((r["page_id"], len(data), sha(data), "revisit" if again else "response", first[data] if again else None, None if again else data))
    got = [(r["key"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload"] and bytes(r["payload"]) if r["record_type"] == "revisit" else bytes(r["payload"])) for r in back]
    assert Counter(got) == Counter(want)
    by_id = {r["record_id"]: r for r in back}
    assert len(by_id) == len(back)
    for r in back:
        if r["refers_to_id"]:
            assert by_id[r["refers_to_id"]]["record_type"] == "response" and by_id[r["refers_to_id"]]["payload_digest"] == r["payload_digest"]


def files_of(folder):
    from glob import glob

    at = folder.removeprefix("file://")
    assert not glob(f"{at}/.*.tmp")
    return {f.rsplit("/", 1)[1]: open(f, "rb").read() for f in glob(f"{at}/*")}


def test_archives_are_equal_in_every_run_and_plain_gzip(spark):
    found = []
    for n in (3, 5):
        folder = fresh_dir(spark, "warc")
        warc.write_warc(odd_pages(spark).repartition(n), folder, shard_bytes=1 << 20, roll_bytes=3000)
        found.append(files_of(folder))
    # Rows of equal key (null, or given twice) with other payloads keep their order by digest, so all bytes agree.
    assert found[0] == found[1]
    for name, data in found[0].items():
        if name.startswith("shard-"):
            for entry in json.loads(data):
                assert hashlib.sha256(found[0][entry["file"]]).hexdigest() == entry["sha256"]
        if name.endswith(".gz"):
            assert gzip.decompress(data).startswith(b"WARC/1.1\r\n")


OTHER_SESSION = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master(f"local[{sys.argv[1]}]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").getOrCreate()
from tessera.llm import warc
warc.write_warc(spark.read.parquet(sys.argv[2]), sys.argv[3], roll_bytes=30_000)
"""


def test_layout_does_not_depend_on_the_cluster(spark, tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    pages = spark.range(0, 6000).select("id", (F.col("id") * 7 % 5000).alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url"), F.repeat(F.sha2((F.col("id") % 5500).cast("string"), 512), 8).alias("html"))
    pages.drop("id").write.parquet(str(tmp_path / "pages"))
    found = []
    for cores in ("1", "3"):
        at = str(tmp_path / f"warc{cores}")
        subprocess.run([sys.executable, "-c", OTHER_SESSION, cores, str(tmp_path / "pages"), at], check=True, timeout=300, cwd=Path(__file__).parents[2])
        found.append(files_of(at))
    assert found[0] == found[1] and sum(n.startswith("shard-") for n in found[0]) > 2


def test_lost_parts_raise(spark):
    folder = fresh_dir(spark, "warc")
    totals = warc.write_warc(odd_pages(spark), folder, shard_bytes=1 << 20, roll_bytes=3000)
    at = folder.removeprefix("file://")
    files = files_of(folder)
    assert sum(n.startswith("shard-") for n in files) == totals["shards"]
    with pytest.raises(FileExistsError):
        warc.write_warc(odd_pages(spark), folder)
    full = next(n for n, data in files.items() if n.startswith("shard-") and len(json.loads(data)) > 1)
    parts = json.loads(files[full])
    import os

    for change in (None, json.dumps(parts[1:]).encode(), json.dumps([dict(parts[0], records=parts[0]["records"] + 1), dict(parts[1], records=parts[1]["records"] - 1), *parts[2:]]).encode()):
        os.remove(f"{at}/{full}")
        if change is not None:
            open(f"{at}/{full}", "wb").write(change)
        with pytest.raises(Exception, match="lacks|promises|records and not"):
            warc.read_warc(spark, folder).count()
        open(f"{at}/{full}", "wb").write(files[full])
    assert warc.read_warc(spark, folder).count() == totals["records"]
    os.remove(f"{at}/{parts[0]['file']}")
    with pytest.raises(Exception, match=parts[0]["file"]):
        warc.read_warc(spark, folder).count()


def test_hot_keys_spread(spark):
    """Nine of ten rows have a null key, half of those are one and the same row; no shard holds more than a few times its share."""
    i = F.col("id")
    html = F.when(i % 10 < 5, F.lit("same")).otherwise(F.repeat(F.sha2(i.cast("string"), 256), 4))
    pages = spark.range(0, 40_000).select(F.when(i % 10 == 9, i).alias("page_id"), F.when(i % 10 >= 5, F.concat(F.lit("u"), i.cast("string"))).alias("url"), html.alias("html"))
    folder = fresh_dir(spark, "warc")
    totals = warc.write_warc(pages, folder)
    held = [sum(f["records"] for f in json.loads(data)) for name, data in files_of(folder).items() if name.startswith("shard-")]
    assert totals["records"] == sum(held) == 40_000 and max(held) < 12_000 and sum(h > 0 for h in held) > 4


def test_empty_archive(spark):
    folder = fresh_dir(spark, "warc")
    assert warc.write_warc(odd_pages(spark).limit(0), folder)["records"] == 0
    assert warc.read_warc(spark, folder).count() == 0


def brute(vectors, queries, k):
    out = []
    for q, v in queries:
        scored = sorted(((-sum(a * b for a, b in zip(v, x)), i) for i, x in vectors if i != q))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize(("n", "width", "most", "block"), [(300, 8, 5, 64), (300, 3, 1, 50), (40, 5, 1 << 30, 16384), (3, 4, 9, 8), (0, 4, 9, 8)])
def test_top_k_equals_brute_force(spark, n, width, most, block):
    rng = np.random.default_rng(n + width)
    rows = [(int(i), [int(x) for x in rng.integers(-most, most + 1, width)]) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, vector array<bigint>")
    got = topk.top_k(df, df.where("id % 3 = 0"), 5, pivots=8, block=block, sample=40).collect()
    assert sorted(map(tuple, got)) == brute(rows, [r for r in rows if r[0] % 3 == 0], 5)


def test_clusters_are_eliminated_and_hot_ids_spread(spark):
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (12, 16))
    rows = [(7 if i % 3 == 0 else i, (centres[i % 12] + rng.integers(-30, 31, 16)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, vector array<bigint>").withColumn("block", F.lit("x")).withColumn("kind", F.lit(1)).withColumn("at", F.lit("y")).repartition(5)
    seen = spark.sparkContext.accumulator(0)
    got = topk.top_k(df, df.where("id % 50 = 0"), 5, block=100, evaluated=seen).collect()
    asked = [r for r in rows if r[0] % 50 == 0]
    assert sorted(map(tuple, got)) == brute(rows, asked, 5)
    assert seen.value < 0.3 * len(rows) * len(asked)


def test_queries_given_twice_are_answered_as_in_sql(spark, tmp_path):
    rows = [(0, [1.0, 0.5], "a"), (0, [0.0, 1.0], "b"), (1, [1.0, 1.0], "c"), (2, [0.5, -1.0], "d"), (2, [0.5, -1.0], "e"), (50, [0.25, 2.0], "f"), (None, [9.0, 9.0], "g")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(map(tuple, topk.op3_exact_topk(spark, str(tmp_path)).collect())) == sorted(con.sql(topk.OP3_SQL).fetchall())


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [0.1]), (6, []), (None, [1.0, 1.0]), (7, [-0.001, 3.0]), (7, [-0.001, 3.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>").select("id", topk.floored(F.col("embedding")).alias("vector"))
    got = topk.top_k(df, df.where("id = 0"), 5).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 7, -256 + 512 * 768), (0, 2, 7, -256 + 512 * 768), (0, 3, 5, 256 * 25), (0, 4, 6, 0)]


def test_huge_components_are_cut(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, -1.0]), (2, [-1e30, 0.0]), (3, [2.0, 2.0])], "id long, embedding array<float>").select("id", topk.floored(F.col("embedding")).alias("vector"))
    got = topk.top_k(df, df.where("id = 0"), 3).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 2**63 - 1), (3, 2**63 - 1), (2, -(2**63))]


def test_urls_equal_sql_on_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "https://EXAMPLE.com/en/x", "http://www.example.com/en/", "http://a.WWW.example.com/en/?q", "http://example.com", "http://example.com/", "http://badexample.com/en/", "x://net/es/1", "x://a.net/fr/#", "x://a.net/de/", "x://net?/es/", "x://user@a.com:80/", "x://a.com.:/", "a://b://c.net/es/", "x://İ.com/", "x://a..com/\n/en/", "x://" + "a." * 3000 + "com/" + "y" * 100_000]
    rows = [(i, u, None, 1) for i, u in enumerate(urls)] + [(3, urls[4], "h", 2), (None, urls[5], None, 3)] + [(i + 100, urls[4], None, 4) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path int")
    rules = spark.createDataFrame(urlfilter.RULES, "verdict string, host string, path string")
    judged = {}
    for r in urlfilter.judge(pages, rules).collect():
        assert judged.setdefault(r["_row"]["url"], tuple(r)[1:]) == tuple(r)[1:]
    assert Counter(r["_row"]["page_id"] for r in urlfilter.judge(pages, rules).collect()) == Counter(r[0] for r in rows)
    con = duckdb.connect()
    con.register("pages", pages.select("page_id", "url").toPandas())
    want = con.sql(urlfilter.OP5_SQL).fetchall()
    by_id = {r[0]: r[1:] for r in want if r[0] is not None and r[0] != 3}
    for i, u in enumerate(urls):
        if i != 3:
            assert by_id[i] == judged[u], u


def test_bloom_filter_has_all_keys_and_few_others(spark):
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("key"))
    bloom = urlfilter.BlockedBloom.build(keys)
    hashed = spark.range(40_000).select(F.xxhash64(F.col("id").cast("string")).alias("h")).toPandas()["h"].to_numpy()
    hits = bloom.has(hashed)
    assert hits[:20_000].all() and hits[20_000:].mean() < 0.02
    tiny = urlfilter.BlockedBloom.build(keys, most_bytes=64)
    assert tiny.has(hashed[:20_000]).all()


def test_false_positives_go_in_the_join_and_misses_are_not_shuffled(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://h{i}.com/{i % 7}/x") for i in range(300)], "page_id long, url string")
    rules = spark.createDataFrame([("block", f"h{i}.com", f"/{i % 7}/") for i in range(0, 300, 3)], "verdict string, host string, path string")
    blocked = lambda: {r["_row"]["page_id"] for r in urlfilter.judge(pages, rules).collect() if r["verdict"] == "block"}
    assert blocked() == set(range(0, 300, 3))
    plan = urlfilter.judge(pages, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan
    monkeypatch.setattr(urlfilter.BlockedBloom, "has", lambda self, hashes: np.ones(len(hashes), bool))
    assert blocked() == set(range(0, 300, 3))
    monkeypatch.setattr(urlfilter, "looked_up", lambda big, small, on, how: big.join(small, on, how))
    assert blocked() == set(range(0, 300, 3))


def test_rules_by_length_and_without_rules(spark):
    pages = spark.createDataFrame([("http://a.b.com/x/y",), ("http://b.com/x",), ("http://com/",)], "url string")
    rules = spark.createDataFrame([("block", "com", "/x/"), ("allow", "b.com", "/"), ("block", "b.com", "/x"), ("allow", "b.com", "/x"), ("block", None, "/"), ("block", "", "/")], "verdict string, host string, path string")
    got = {r["_row"]["url"]: (r["rule"], r["verdict"]) for r in urlfilter.judge(pages, rules).collect()}
    assert got == {"http://a.b.com/x/y": ("b.com/x", "block"), "http://b.com/x": ("b.com/x", "block"), "http://com/": (None, "allow")}
    assert {r["verdict"] for r in urlfilter.judge(pages, rules.limit(0)).collect()} == {"allow"}
    assert urlfilter.judge(pages.limit(0), rules).count() == 0
