"""The thin queries over the smallest tables: their contracts, against SQL or brute force."""

import base64
import hashlib
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from tessera.llm import langid, packing
from tessera.llm.queries import QUERIES, SQL

from .test_media_text_models import brute
from .test_mixing_sharding_packing import filled

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{DATA}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def pages():
    return duckdb.sql(f"SELECT page_id, url, html FROM '{DATA}/pages.parquet' ORDER BY page_id").fetchall()


def run(spark, prefix):
    name = next(n for n in QUERIES if n.startswith(prefix))
    return QUERIES[name](spark, DATA).collect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA), con.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = [tuple(r[c] for c in want.columns) for r in got.collect()]
    assert Counter(map(repr, rows)) == Counter(map(repr, want.fetchall()))


def test_op1(spark, docs):
    rows = run(spark, "op1_")
    sizes = {d: len((t or "").split()) for d, t, _, _ in docs}
    by_source = Counter()
    for d, _, _, s in docs:
        by_source[s] += sizes[d]
    want, taken = filled(by_source), Counter()
    source = {d: s for d, _, _, s in docs}
    assert sorted(r["doc_id"] for r in rows) == sorted(sizes)
    for r in rows:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (sizes[r["doc_id"]], by_source[s]) and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in want:
        assert abs(taken[s] - want[s]) <= max(sizes[d] for d in sizes if source[d] == s)
    assert sorted(rows) == sorted(run(spark, "op1_"))


def test_op2(spark, pages):
    rows, first = {r["page_id"]: r for r in run(spark, "op2_")}, {}
    assert len(rows) == len(pages)
    for p, _, html in pages:
        data = (html or "").encode()
        r = rows[p]
        again = data in first
        first.setdefault(data, p)
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[data] if again else None)


def test_op4(spark, docs):
    rows = {r["doc_id"]: r for r in run(spark, "op4_")}
    seen = {}
    for d, t, _, _ in docs:
        data = (t or "").encode()
        pad = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        r = rows[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        assert seen.setdefault(t, tuple(r)[1:]) == tuple(r)[1:]


def test_op6(spark, docs):
    rows, shards, sizes = {r["doc_id"]: r for r in run(spark, "op6_")}, defaultdict(list), Counter()
    for d, t, _, _ in docs:
        data, r = (t or "").encode(), rows[d]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        shards[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert set(shards) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in rows.values())


def test_op7_and_op9(spark, docs):
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{DATA}/labels.parquet'").fetchall())
    langs = {d: x for d, _, x, _ in docs}
    a, b = run(spark, "op7_"), run(spark, "op9_")
    for r in [*a, *b]:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in a if r["held_out"]]) > 0.85
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in b)
    held = [r for r in b if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.85
    assert langid.UNKNOWN == "und"


def test_op8(spark, docs):
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in run(spark, "op8_")}
    classes, links = brute([t for _, t, _, _ in docs])
    ids = [d for d, _, _, _ in docs]
    assert got == {d: (ids[c], n) for d, c, n in zip(ids, classes, links, strict=True)}


def test_op10(spark, docs):
    from tokenizers import Tokenizer

    whole, rows, filled_ = Tokenizer.from_file(packing.word_bpe()), defaultdict(list), defaultdict(list)
    for r in run(spark, "op10_"):
        rows[r["doc_id"]].append(r)
        filled_[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, t, _, _ in docs:
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(rows[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for parts in filled_.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert sum(n for p in filled_.values() for _, n in p) / (2048 * len(filled_)) > 0.97
