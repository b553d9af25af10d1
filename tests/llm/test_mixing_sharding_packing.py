import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.llm import mixing, packing, sharding

from .fixtures import odd_documents


def filled(sizes, ratio=1.5, cap=2.0, weights=(3, 1, 2)):
    """Targets by resharing the excess step by step."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = ratio * sum(sizes.values()), set(names), {}
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 1000, "c": 20, None: 5}, {"a": 0, "b": 7}, {"Z": 5, "a": 50, "b": 1, "é": 90, "zz": 3}])
def test_targets_equal_stepwise_resharing(spark, sizes):
    frame = spark.createDataFrame([(k, v, 1) for k, v in sizes.items()], "source string, source_size long, n long")
    got = {r["source"]: r["target"] for r in mixing.targets(frame).collect()}
    assert got == pytest.approx(filled(sizes))


def mixed(df, **options):
    return mixing.mix(df, mixing.words(F.col("text")), **options).collect()


@pytest.mark.parametrize("leaf", [4096, 3])
def test_mix_takes_near_targets_and_repeats_itself(spark, leaf):
    docs = odd_documents(spark)
    rows = mixed(docs, per_leaf=leaf, fan=4)
    assert Counter(r["_row"] for r in rows) == Counter(docs.collect())
    assert Counter(map(str, rows)) == Counter(map(str, mixed(docs.repartition(7), per_leaf=leaf, fan=4)))
    taken, target, largest = Counter(), {}, Counter()
    for r in rows:
        s = r["_row"]["source"]
        assert 0 <= r["_copies"] <= 2
        taken[s] += r["_copies"] * r["_size"]
        target[s] = r["_target"]
        largest[s] = max(largest[s], r["_size"])
    for s in target:
        assert abs(taken[s] - target[s]) <= largest[s] + 1e-6


def test_ties_do_not_depend_on_partitions(spark):
    """Rows of one id and equal sizes with two texts, and equal rows that fill several leaves."""
    rows = [(1, "a b c" if i % 2 else "d e f", "s") for i in range(40)] + [(None, f"x{i % 5} y", "s") for i in range(60)] + [(i, "w " * (i % 9), "s" if i % 2 else "t") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = [Counter(map(str, mixed(docs.repartition(n), per_leaf=leaf, fan=4))) for leaf in (4096, 4) for n in (1, 3, 7)]
    assert found[0] == found[1] == found[2] and found[3] == found[4] == found[5]
    assert sum(found[0].values()) == len(rows)


def test_sources_of_like_shape_round_unlike(spark):
    docs = spark.createDataFrame([(i, "w w w", f"s{i // 40:02d}") for i in range(1600)], "doc_id long, text string, source string")
    rows = mixed(docs, per_leaf=4, fan=4, weights=(1,))
    taken = Counter()
    for r in rows:
        taken[r["_row"]["source"]] += r["_copies"]
    by_place = {s: tuple(r["_copies"] for r in sorted(rows, key=lambda r: r["_row"]["doc_id"]) if r["_row"]["source"] == s) for s in taken}
    assert set(taken.values()) == {60} and len(set(by_place.values())) > 30


def test_many_sources_fill_alike(spark):
    sizes = {f"s{i:04d}": (i * 7919) % 1000 for i in range(700)}
    frame = spark.createDataFrame([(k, v, 1) for k, v in sizes.items()], "source string, source_size long, n long").repartition(5)
    assert {r["source"]: r["target"] for r in mixing.targets(frame).collect()} == pytest.approx(filled(sizes))


def test_chances_are_kept(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), "a" if i % 3 else "b") for i in range(60)], "doc_id long, text string, source string")
    times, runs = Counter(), 40
    for seed in range(runs):
        for r in mixed(docs, seed=seed, per_leaf=16, weights=(1, 1)):
            times[r["_row"]["doc_id"]] += r["_copies"]
            want = r["_target"] / r["_source_size"]
    by_source = [np.mean([times[i] / runs for i in range(60) if bool(i % 3) == a]) for a in (True, False)]
    assert max(abs(times[i] / runs - by_source[0 if i % 3 else 1]) for i in range(60)) < 0.45
    assert want > 0


def test_mixed_rows_keep_columns_and_empty_tables(spark):
    docs = odd_documents(spark)
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_shards_are_even_and_gapless(spark):
    rows = [(i, (i * 37) % 90 + 1, 5 if i % 3 == 0 else i * 7919) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, size long, key long").withColumn("shard", F.lit(99)).withColumn("_range", F.lit("x"))
    out = sharding.assign_shards(df, 16, "size", "key", ["doc_id"]).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(3000)) and all(r["_range"] == "x" for r in out)
    sizes, slots = Counter(), {}
    for r in out:
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(sizes) == 16
    assert max(sizes.values()) < 1.12 * sum(sizes.values()) / 16 and min(sizes.values()) > 0.88 * sum(sizes.values()) / 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_splitters_equal_exact_quantiles_where_all_keys_are_drawn(spark):
    """At a rate that draws every key, boundaries are the quantiles of the running size by key; heavy keys are alone and divided."""
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(-(1 << 62), 1 << 62, 500)).tolist()
    sizes = [int(x) for x in rng.integers(1, 50, len(keys))]
    sizes[100] = 9000
    total, ranges = sum(sizes), 20
    found = sharding.sampled_splitters(spark.createDataFrame(list(zip(keys, sizes, strict=True)), "k long, w long"), total, ranges, per_range=total)
    ends = np.cumsum(sizes)
    want = {-(1 << 63), keys[100], keys[100] + 1} | {keys[int(np.searchsorted(ends, total * i / ranges))] for i in range(1, ranges)}
    assert set(found.starts.tolist()) == want
    assert dict(zip(found.starts.tolist(), found.parts.tolist(), strict=True))[keys[100]] == -(-9000 // int(2 * total / ranges))


def test_overfull_ranges_are_divided(spark):
    """However coarse the first sample, no range but that of a heavy key outweighs twice its share by more than a key."""
    sizes = {i * i: 1 + i % 3 for i in range(4000)} | {-5: 3000}
    total = sum(sizes.values())
    weights = spark.createDataFrame(list(sizes.items()), "k long, w long")
    for per_range in (1, 16):
        found = sharding.sampled_splitters(weights, total, 64, per_range=per_range)
        at = found.locate(np.array(list(sizes)), np.zeros(len(sizes)))
        held = Counter()
        for r, (k, w) in zip(at.tolist(), sizes.items(), strict=True):
            held[r] += w if k != -5 else 0
        assert max(held.values()) <= 2 * total / 64 + 3


def test_slots_by_buckets(spark):
    rows = [(i, i % 11 + 1, 5 if i % 3 == 0 else i * 7919) for i in range(3000)] + [(None, 4, 6)] * 500
    df = spark.createDataFrame(rows, "doc_id long, size long, key long").repartition(6)
    out = sharding.assign_shards(df, 4, "size", "key", ["doc_id"], per_bucket=7).collect()
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(out) == 3500 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_odd_rows(spark):
    docs = odd_documents(spark).withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    out = sharding.assign_shards(docs, 4, "size", "key", ["doc_id"])
    assert out.count() == docs.count()
    for r in out.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("top"), F.countDistinct("slot").alias("d")).collect():
        assert r["n"] == r["top"] + 1 == r["d"]
    assert sharding.assign_shards(docs.limit(0), 4, "size", "key", ["doc_id"]).count() == 0


def naive_first_fit(lengths, capacity):
    rooms, out = [], []
    for n in lengths:
        b = next((i for i, r in enumerate(rooms) if r >= n), len(rooms))
        if b == len(rooms):
            rooms.append(capacity)
        out.append((b, capacity - rooms[b]))
        rooms[b] -= n
    return out


def test_tournament_tree_is_first_fit():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 50, 333):
        lengths = sorted(rng.integers(1, 101, n).tolist(), reverse=True)
        assert list(zip(*packing.first_fit_decreasing(lengths, 100), strict=True)) == naive_first_fit(lengths, 100)


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.word_bpe())


def test_word_cache_equals_tokenizer(whole):
    texts = ["", "It's we'll 's 'd a'b''c", "Straße ÄÖÜ œuvre ½ x²", "á é Å", "<|endoftext|> <|startoftext|>x", "tab\there\r\nnew 12345 £5", "日本語     x", "A" * 5000, "ΑΣ ΑΣΑ İI", "<|notspecial|>", "..!! ''' '", "\x00\x07bell \ud83d"]
    for small in (2, 1000):
        encode = packing.WordTokenizer(packing.word_bpe(), most_words=small)
        for t in texts:
            t = t.encode("utf-8", "replace").decode()
            assert np.frombuffer(encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_other_tokenizers_of_this_shape_are_run_whole(tmp_path, whole):
    import json

    made = json.load(open(packing.word_bpe(), encoding="utf-8"))
    made["normalizer"]["normalizers"][1]["content"] = "x"
    at = str(tmp_path / "other.json")
    json.dump(made, open(at, "w", encoding="utf-8"))
    from tokenizers import Tokenizer

    other, encode = Tokenizer.from_file(at), packing.WordTokenizer(at)
    assert packing.WordTokenizer(packing.word_bpe()).by_word and not encode.by_word
    text = "some words here"
    assert np.frombuffer(encode(text), "<u4").tolist() == other.encode(text, add_special_tokens=False).ids != whole.encode(text, add_special_tokens=False).ids


def test_packing_does_not_depend_on_partitions(spark):
    docs = odd_documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    found = [sorted(map(tuple, packing.packed(docs.repartition(n)).collect())) for n in (1, 4)]
    assert found[0] == found[1]


def test_pieces_cover_each_document_once(spark, whole):
    docs = odd_documents(spark)
    out = packing.packed(docs, with_ids=True).collect()
    rows, starts = Counter((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), Counter(r["doc_id"] for r in out if r["start"] == 0)
    assert starts == Counter(d for d, _ in rows.elements())
    texts = {d: t for d, t in rows if d is not None}
    for r in out:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] and 0 < r["length"] <= 2048
        if r["doc_id"] is not None:
            ids = whole.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [1]
            assert np.frombuffer(r["ids"], "<u4").tolist() == ids[r["start"] : r["start"] + r["length"]] and r["doc_tokens"] == len(ids)
    filled = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 2048
    assert packing.packed(docs.limit(0)).count() == 0
