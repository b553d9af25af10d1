"""Fill-in-the-middle against plain string slicing."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tessera.llm import fim

SCHEMA = "doc_id long, text string, n long, form string, _text string, output string"


def plain(text, doc_id, percent=90, spm=20, seed=1, units=list):
    """(n, form, prefix, middle, output) by the definition."""
    text, key = text or "", "" if doc_id is None else doc_id
    parts, h = units(text), hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(parts)
    a, b = sorted([h[0] % (n + 1), h[1] % (n + 1)])
    if not text or any(x in text for x in fim.SENTINELS) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    p, m, s = ("".join(x) for x in (parts[:a], parts[a:b], parts[b:]))
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def words(text):
    import re

    return re.findall(r"^[ \t\n\r\f\v]+|[^ \t\n\r\f\v]+[ \t\n\r\f\v]*", text)


def lines(text):
    out = text.split("\n")
    return [x + "\n" for x in out[:-1]] + ([out[-1]] if out[-1] else [])


def corpus(n=400):
    rng = random.Random(3)
    some = ["a", "é", "漢", "😀", " ", "\n", "\t", "<", "P>", "<P>", "S", ">", "word", "", "é", "\r\n"]
    return [(None if i % 17 == 0 else i % 150, None if i % 23 == 0 else "".join(rng.choice(some) for _ in range(rng.choice([0, 1, 2, 5, 60, 900])))) for i in range(n)]


@pytest.mark.parametrize(("unit", "units"), [("chars", list), ("words", words), ("lines", lines)])
@pytest.mark.parametrize("stripe", [3, 64, 1 << 20])
def test_equals_slicing(monkeypatch, unit, units, stripe):
    monkeypatch.setattr(fim, "STRIPE", stripe)
    rows = [(i, t or "") for i, t in corpus(150)]
    texts = pa.array(["unused", *(t for _, t in rows)]).slice(1)
    h = [hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest() for i, _ in rows]
    h1, h2 = (np.array([int(x[k : k + 8], 16) for x in h]) for k in (0, 8))
    want = [plain(t, i, units=units) for i, t in rows]
    form = np.array([("plain", "psm", "spm").index(w[1]) for w in want])
    n, prefix, middle, output = fim.rearrange(texts, h1, h2, form, unit)
    for i, w in enumerate(want):
        assert (n[i], output[i].as_py()) == (w[0], w[4])
        if w[2] is not None:
            assert (prefix[i], middle[i]) == w[2:4]


def test_operator(spark):
    rows = [(i, t, 1, "x", "y", "z") for i, t in corpus()] + [(5, "x" * 300_000 + "é" * 9, 2, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = fim.transformed(df.select("doc_id", "text", F.struct("n", "form", "_text", "output").alias("_row")), ["doc_id", "text", "_row"])
    out = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r["n"], r["form"], r["prefix_units"], r["middle_units"], r["output"]) == plain(r["text"], r["doc_id"])
        assert r["back"] == (r["text"] or "")
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}


def test_options_and_empty(spark):
    df = spark.createDataFrame([(i, f"one two {i}\nthree") for i in range(200)], "doc_id long, text string")
    out = fim.transformed(df, ["doc_id", "text"], percent=50, spm_percent=50, seed=9, unit="words").collect()
    for r in out:
        assert (r["n"], r["form"], r["prefix_units"], r["middle_units"], r["output"]) == plain(r["text"], r["doc_id"], 50, 50, 9, words)
    assert fim.transformed(df.where("false"), ["doc_id"]).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        fim.transformed(df, ["doc_id"], sentinels=("<P>", ">S<", "<M>"))
    with pytest.raises(ValueError, match="unit"):
        fim.transformed(df, ["doc_id"], unit="pages")
