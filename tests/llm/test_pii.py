"""Spans of personal data against the patterns as they are defined, tried from every place."""

import hashlib
import os
import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F
from tessera.llm import pii

DATA = "/root/testdata/sf0.001"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, found):
    digits = [int(c) for c in found if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        doubled = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and doubled % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    found = [(m.start(), list(PATTERNS).index(k), k, m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if holds(k, m.group())]
    return [(k, s, e) for s, _, k, e in sorted(found)]


def got(text):
    return [(k, s, e) for s, e, k, _ in pii.spans(text) if k in PATTERNS]


def texts(n, seed):
    rng = random.Random(seed)
    some = [*"0123456789", *"0123456789", ".", "-", " ", "@", "+", "a", "B", "_", "%", "é", "(", ")", "1.2.3.4", "256", "4111 1111 1111 1111", "+1 (743) 555-3824", "a.b@c-d.ef", "@@", "..", "٣"]
    return ["".join(rng.choice(some) for _ in range(rng.choice([3, 12, 40, 120]))) for _ in range(n)]


def test_base_spans_equal_the_patterns():
    some = texts(6000, 1)
    assert all(got(t) == base(t) for t in some)
    assert {k for t in some for k, _, _ in base(t)} == set(PATTERNS)


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112") and pii.luhn("0")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765431")


def test_added_spans_need_a_checksum_or_words_nearby():
    kinds = lambda t: [(k, t[s:e]) for s, e, k, _ in pii.spans(t)]
    assert kinds("IBAN: GB82 WEST 1234 5698 7654 32 BIC") == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert kinds("XX12 AB DE89370400440532013000.") == [("iban", "DE89370400440532013000")]
    assert kinds("GB82 WEST 1234 5698 7654 31") == kinds("DE8937040044053201300") == kinds("DE893704004405320130001") == []
    assert kinds("ssn 123-45-6789") == [("ssn", "123-45-6789")]
    assert kinds("123-45-6789") == kinds("ssn 000-45-6789") == kinds("ssn 912-45-6789") == kinds("order, ssn 123-45-6789") == []
    assert kinds("call (743) 555-3824 now") == [("local_phone", "(743) 555-3824")]
    assert kinds("size (743) 555-3824 now") == []
    assert kinds("phone +1 (743) 555-3824") == [("phone", "+1 (743) 555-3824")]
    assert kinds("tel 743-555-3824, tel 743-555-3825") == [("local_phone", "743-555-3824"), ("local_phone", "743-555-3825")]


def test_words_nearby_move_the_score():
    score = lambda t: pii.spans(t)[0][3]
    assert score("server 10.0.0.1") > score("10.0.0.1") > score("version 10.0.0.1")
    assert score("Kreditkarte 4111111111111111") > score("4111111111111111")
    assert score("server" + "x " * 60 + "10.0.0.1") == score("10.0.0.1")
    assert all(0 <= s <= 1 for t in texts(300, 5) for _, _, _, s in pii.spans("mail phone card server version " + t))


def test_long_runs_take_linear_time():
    began = time.time()
    for run in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "1 " * 150_000, "+1" + " " * 300_000, "+1" * 150_000, "a@" * 150_000, "DE89" * 75_000, "AB12 " * 60_000, "123-45-" * 40_000):
        pii.spans(run)
    assert time.time() - began < 20


def test_operator(spark):
    some = [*texts(300, 9), None, "", "ssn 123-45-6789 at a@b.cd", "x" * 9_000 + " 10.0.0.1", "a@b.cd", "a@b.cd"]
    df = spark.createDataFrame([(i % 290, t, "x", 1) for i, t in enumerate(some)], "doc_id long, text string, pii string, _text long")
    out = pii.detected(df.select(F.struct("*").alias("_row"), "text"), ["_row"], with_redacted=True).collect()
    assert len(out) == len(some)
    for r in out:
        t = r["_row"]["text"] or ""
        assert [(x["kind"], x["start"], x["end"]) for x in r["pii"] if x["base"]] == base(t)
        assert [(x["start"], x["end"], x["kind"], x["score"]) for x in r["pii"]] == pii.spans(t)
        assert r["redacted"] == pii.redact(t, pii.spans(t)) and (r["pii"] or r["redacted"] == t)
    assert [r["redacted"] for r in out if (r["_row"]["text"] or "").startswith("ssn")] == ["ssn [ssn] at [email]"]
    assert pii.detected(df.where("false"), ["doc_id"]).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_query(spark):
    rows = pii.op12_personal_data(spark, DATA).collect()
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall())
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        want = base(docs[r["doc_id"]] or "")
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(w[0] == k for w in want) for k in PATTERNS]
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(filter(None, r["spans"].split(",")))
