import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.llm import jpeg, langid, ngram_join, quality
from tessera.llm.components import components

from . import plain_jpeg
from .fixtures import odd_documents, words


def picture(rng, width, height, parts, dense):
    image = jpeg.Image(width, height, jpeg.frame(width, height, parts), {0: rng.integers(1, 40, 64), 1: rng.integers(1, 40, 64)})
    for c in image.components:
        shape = c.coefficients.shape
        values = np.where(rng.random(shape) < dense, rng.integers(-90, 91, shape), 0)
        values[rng.random(shape[:2]) < 0.4, 1:] = 0
        values[..., 0] = rng.integers(-60, 61, shape[:2])
        values[c.own_down :, :, 1:] = 0
        values[:, c.own_across :, 1:] = 0
        if len(parts) == 1:
            values[c.own_down :] = 0
            values[:, c.own_across :] = 0
        c.coefficients = values.astype(np.int32)
    return image


def by_definition(image):
    """The picture by the textbook double sum, sample by sample plane, in floating point."""
    k = np.arange(8)
    basis = np.where(k == 0, np.sqrt(0.5), 1.0)[:, None] / 2 * np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16)
    vm, hm = max(c.v for c in image.components), max(c.h for c in image.components)
    planes = []
    for c in image.components:
        plane = np.zeros((c.down * 8, c.across * 8))
        for y in range(c.down):
            for x in range(c.across):
                natural = np.zeros(64)
                natural[jpeg.ZIGZAG] = c.coefficients[y, x] * image.quant[c.table]
                plane[y * 8 : y * 8 + 8, x * 8 : x * 8 + 8] = basis.T @ natural.reshape(8, 8) @ basis
        plane = np.clip(plane + 128, 0, 255)
        planes.append(plane.repeat(vm // c.v, 0).repeat(hm // c.h, 1)[: image.height, : image.width])
    if len(planes) == 1:
        return np.stack(planes * 3, 2)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    return np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2), 0, 255)


@pytest.mark.parametrize("parts", [[(1, 1)], [(1, 1)] * 3, [(2, 1), (1, 1), (1, 1)], [(2, 2), (1, 1), (1, 1)], [(1, 2), (1, 1), (1, 1)]])
@pytest.mark.parametrize("al", [0, 1, 3])
def test_scans_round_trip_and_pixels(parts, al):
    rng = np.random.default_rng(len(parts) + al)
    for width, height, dense in ((37, 29, 0.1), (8, 8, 0.9), (65, 1, 0.0)):
        image = picture(rng, width, height, parts, dense)
        back = jpeg.read(jpeg.encode(image, al=al))
        for a, b in zip(image.components, back.components, strict=True):
            assert (a.coefficients == b.coefficients).all()
        assert np.abs(jpeg.rgb(back).astype(float) - by_definition(image)).max() <= 3


def test_zigzag_starts_as_the_standard_has_it():
    assert jpeg.ZIGZAG[:12].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25] and sorted(jpeg.ZIGZAG) == list(range(64))


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 384, 385, 5000, 384 * 4095 + 1])
def test_payload_round_trip(n):
    data = jpeg.padded(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes())
    media = jpeg.payload_to_jpeg(data)
    image = jpeg.read(media)
    assert len(data) % 64 == 0 and data and jpeg.jpeg_to_payload(image) == data
    assert [(c.h, c.v) for c in image.components] == [(2, 2), (1, 1), (1, 1)]
    if n <= 5000:
        for mine, other in zip(image.components, plain_jpeg.coefficients(media), strict=True):
            assert (mine.coefficients == other).all()
        assert np.abs(jpeg.rgb(image).astype(float) - by_definition(image)).max() <= 3
    if n == 5000:
        text = bytes(range(65, 91)) * 50
        assert jpeg.jpeg_to_payload(jpeg.read(jpeg.payload_to_jpeg(jpeg.padded(text)))) == jpeg.padded(text)


@pytest.mark.parametrize("parts", [[(1, 1)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
@pytest.mark.parametrize("al", [0, 2])
def test_scans_equal_those_read_bit_by_bit(parts, al, monkeypatch):
    rng = np.random.default_rng(7)
    for width, height, dense in ((37, 29, 0.1), (40, 70, 0.5), (100, 90, 0.01), (8, 8, 1.0)):
        media = jpeg.encode(picture(rng, width, height, parts, dense), al=al)
        for stretch in (1 << 16, 64):
            monkeypatch.setattr(jpeg, "STRETCH", stretch)
            for mine, other in zip(jpeg.read(media).components, plain_jpeg.coefficients(media), strict=True):
                assert (mine.coefficients == other).all()


def test_restarts_and_tables_by_component():
    """A scan with a restart after each unit, whose components have Huffman tables of their own."""
    def bits(*items):
        text = "".join(items)
        return int(text + "1" * (-len(text) % 8), 2).to_bytes((len(text) + 7) // 8)

    image = jpeg.Image(16, 8, jpeg.frame(16, 8, [(1, 1)] * 3), {0: np.ones(64, np.int32), 1: np.ones(64, np.int32)})
    # Table 0: 0 -> 0, 2 -> 10, 3 -> 110. Table 1: 2 -> 00, 0 -> 01, 3 -> 10.
    tables = jpeg._table_segment(0, 0, [(0, 1), (2, 2), (3, 3)]) + jpeg._table_segment(0, 1, [(2, 2), (0, 2), (3, 2)])
    scan = b"\xff\xdd\x00\x04\x00\x01" + jpeg._segment(0xDA, bytes([3, 1, 0x00, 2, 0x10, 3, 0x10, 0, 0, 0]))
    first, second = bits("10", "11", "00", "10", "10", "000"), bits("110", "111", "01", "00", "01")
    media = jpeg._head(image) + tables + scan + first + b"\xff\xd0" + second + b"\xff\xd9"
    want = [[3, 7], [2, 0], [-7, -2]]
    assert [c.coefficients[0, :, 0].tolist() for c in jpeg.read(media).components] == want == [c[0, :, 0].tolist() for c in plain_jpeg.coefficients(media)]
    with pytest.raises(ValueError, match="restarts"):
        jpeg.read(jpeg._head(image) + tables + scan + first + b"\xff\xd9")


def test_media_columns_of_odd_texts(spark):
    docs = odd_documents(spark)
    rows = jpeg.media_columns(docs, with_media=True).collect()
    texts = docs.select("doc_id", "text").collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(t["doc_id"] for t in texts)
    want = Counter()
    for t in texts:
        data = (t["text"] or "").encode()
        pad = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        want[t["doc_id"], len(data), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:])] += 1
    assert want == Counter(tuple(r)[:5] for r in rows)
    for r in rows[:20]:
        assert bytes(r["rgb"]) == jpeg.decode(bytes(r["media"])).tobytes() and len(r["rgb"]) == 3 * r["height"] * r["width"]
    assert all(r["media_bytes"] == len(r["media"]) and hashlib.sha256(r["media"]).hexdigest() == r["media_sha256"] for r in rows)
    assert jpeg.media_columns(docs.limit(0)).count() == 0


def test_decoded_column(spark):
    good = jpeg.encode(picture(np.random.default_rng(5), 20, 10, [(2, 2), (1, 1), (1, 1)], 0.2))
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(good[:60])), (3, None), (4, bytearray(b"x"))], "id long, media binary")
    rows = {r["id"]: r for r in jpeg.decode_column(df, kept=("id",)).collect()}
    assert (rows[1]["height"], rows[1]["width"], bytes(rows[1]["rgb"])) == (10, 20, jpeg.decode(good).tobytes())
    assert all(rows[i]["rgb"] is None and rows[i]["error"] for i in (2, 3, 4))


def test_ngrams_equal_sets_of_words():
    rng = random.Random(2)
    texts = [words(rng, n, "ab") for n in (0, 1, 4, 5, 6, 40, 300)] + ["A b! c_d é́ İ 12", ""]
    import re

    def plain(t):
        w = re.findall(r"[^\W_]+", t.lower())
        w = ["".join(c for c in x if c.isalnum()) for x in w]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    for t in texts[:7]:
        assert len(ngram_join.ngrams(t)) == len(plain(t))
    for a in texts[:7]:
        for b in texts[:7]:
            assert len(np.intersect1d(ngram_join.ngrams(a), ngram_join.ngrams(b))) == len(plain(a) & plain(b))


def test_banding_reaches_recall():
    for t in (0.5, 0.8, 0.9):
        b, r = ngram_join.banding(t, 0.99)
        assert 1 - (1 - t**r) ** b >= 0.99 and b * r <= 160
    with pytest.raises(ValueError, match="hashes"):
        ngram_join.banding(0.05, 0.999999, 8)


def families(rng, n):
    """Texts with copies and with near copies of all degrees."""
    out = []
    for f in range(n):
        base = words(rng, rng.randint(30, 120)).split()
        for _ in range(rng.randint(1, 12)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                t[rng.randrange(len(t))] = f"new{rng.random()}"
            out.append(" ".join(t))
    return out


def brute(texts, threshold=0.8):
    sets = [set(ngram_join.ngrams(t or "").tolist()) for t in texts]
    up, links = list(range(len(texts))), [0] * len(texts)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (texts[i] or "") == (texts[j] or "") or sets[i] and both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))], links


@pytest.mark.parametrize(("block", "grams", "together"), [(512, 1 << 20, 50_000), (4, 1 << 20, 50_000), (512, 300, 3)])
def test_join_equals_brute_force(spark, monkeypatch, block, grams, together):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", grams)
    monkeypatch.setattr(ngram_join, "HOT", 1 if together == 3 else 1000)
    monkeypatch.setattr(ngram_join, "MOST_TOGETHER", together)
    texts = families(random.Random(8), 25) + ["", "", None, "a", "a b", "a b", "A  b.", "!!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("h", F.lit("x"))
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in ngram_join.join(docs).collect()}
    classes, links = brute(texts)
    assert got == {i: (classes[i], links[i]) for i in range(len(texts))}
    kept = ngram_join.deduplicated(docs).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(classes)) and kept[0]["h"] == "x"


def test_texts_of_equal_hashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "_first", lambda text: F.pmod(F.xxhash64(text), F.lit(7)))
    texts = families(random.Random(9), 8) + ["", None, "a", "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes, links = brute(texts)
    assert {r["doc_id"]: (r["class_id"], r["links"]) for r in ngram_join.join(docs).collect()} == {i: (classes[i], links[i]) for i in range(len(texts))}
    assert sorted(r["doc_id"] for r in ngram_join.deduplicated(docs).collect()) == sorted(set(classes))


def test_one_large_family(spark):
    """20,000 near copies of one text: each differs in one word of the last ten, so all are one class, in blocks, and links can be counted."""
    rng = random.Random(10)
    base = words(rng, 200).split()
    texts = [" ".join([*base[:199], f"last{i}"]) for i in range(20_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = ngram_join.join(docs).groupBy("class_id", "links").count().collect()
    assert [tuple(r) for r in got] == [(0, 19_999, 20_000)]


def test_recall_by_similarity(spark):
    """No pair at the threshold or more is lost, in each band of similarity up from 0.8."""
    rng = random.Random(11)
    texts = []
    for _ in range(400):
        base = words(rng, rng.randint(60, 200)).split()
        texts.append(" ".join(base))
        cut = int(len(base) * rng.uniform(0.0, 0.24))
        texts.append(" ".join([*base[: len(base) - cut], *[f"n{rng.random()}" for _ in range(rng.randint(0, 2))]]))
    sets = [set(ngram_join.ngrams(t).tolist()) for t in texts]
    similar = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    by_id = {r["doc_id"]: r["class_id"] for r in ngram_join.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    bands = Counter(), Counter()
    for i, x in enumerate(similar):
        bands[0][int(x * 20)] += 1
        bands[1][int(x * 20)] += by_id[2 * i + 1] == by_id[2 * i]
    assert {k: bands[1][k] / bands[0][k] for k in bands[0]} == {k: float(k >= 16) for k in bands[0]} and min(bands[0][k] for k in (16, 17, 18, 19)) > 20


def test_join_of_odd_rows(spark):
    docs = odd_documents(spark)
    out = ngram_join.join(docs).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in docs.collect())
    kept = ngram_join.deduplicated(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({r["class_id"] for r in out})
    assert ngram_join.join(docs.limit(0)).count() == 0 == ngram_join.deduplicated(docs.limit(0)).count()


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(140)] + [(i, i + 1) for i in range(300, 360)] + [(500, i) for i in range(501, 560)] + [(9, 9)]
    up = {x: x for e in edges if e[0] != e[1] for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up}


LETTERS = {"xx": "abcde", "yy": "defgh", "zz": "ijkéü"}


def labelled(rng, n):
    return [(words(rng, rng.randint(5, 60), LETTERS[lang]), lang) for lang in LETTERS for _ in range(n)]


def test_folded_scores_equal_the_kernel_regression():
    """The folded matrix gives what kernel ridge regression in the Nyström space gives through kernel values."""
    rng = random.Random(1)
    data = labelled(rng, 12)
    texts, labels = [t for t, _ in data], [y for _, y in data]
    model = langid.fit(texts, labels, landmarks=4, ridge=1e-2)
    sets = [set(np.flatnonzero(langid.presence(t))) for t in texts]
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    marks = [i for y in sorted(LETTERS) for i in [i for i, z in enumerate(labels) if z == y][:4]]
    kmm = np.array([[kernel(sets[i], sets[j]) for j in marks] for i in marks])
    values, vectors = np.linalg.eigh(kmm)
    root = vectors / np.sqrt(values)
    phi = np.array([[kernel(s, sets[j]) for j in marks] for s in sets]) @ root
    y = np.array([[1.0 if a == b else -1.0 for b in sorted(LETTERS)] for a in labels])
    f = phi - phi.mean(0)
    w = np.linalg.solve(f.T @ f + 1e-2 * len(texts) * np.eye(f.shape[1]), f.T @ (y - y.mean(0)))
    want = f @ w + y.mean(0)
    present = np.stack([langid.presence(t) for t in texts])
    got = present @ model.weights / np.sqrt(present.sum(1))[:, None] + model.offset
    assert np.abs(got - want).max() < 1e-3


def test_language_of_held_out_and_odd_texts(spark):
    rng = random.Random(6)
    rows = [(i, t, y) for i, (t, y) in enumerate(labelled(rng, 60))] + [(1000, None, "xx"), (1001, "", "xx"), (1002, "12 !?", "yy"), (1003, words(rng, 20_000, LETTERS["zz"]), None), (None, "abc abd", None), (1003, "abc abd", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = langid.identify(docs, langid.train(docs), ["doc_id", "lang", "text"]).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["lang_pred"] == r["lang"] for r in got if r["doc_id"] is not None and r["doc_id"] < 1000]) > 0.97
    odd = {(r["doc_id"], r["text"] and len(r["text"]) > 100): r["lang_pred"] for r in got if r["doc_id"] is None or r["doc_id"] >= 1000}
    assert odd[1000, None] == odd[1001, ""] == odd[1002, False] == "und" and odd[1003, True] == "zz"
    none = langid.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langid.identify(docs, none, ["doc_id"]).collect()} == {"und"}
    assert langid.identify(docs.limit(0), none, ["doc_id"]).count() == 0


def test_quality_of_held_out_and_odd_texts(spark):
    rng = random.Random(7)
    good = [words(rng, rng.randint(10, 60)) for _ in range(150)]
    bad = [" ".join(w + "$%&"[i % 3] for i, w in enumerate(words(rng, 30).split())) if k % 2 else " ".join([good[k % 16].split()[0]] * 20) for k in range(150)]
    texts = [t for pair in zip(good, bad, strict=True) for t in pair]
    docs = spark.createDataFrame([*enumerate(texts), (5000, None), (5001, ""), (5002, words(rng, 20_000)), (None, "x"), (0, texts[0])], "doc_id long, text string").withColumn("score", F.lit("s"))
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(300)] + [(0, None, None), (None, 1, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model, ["doc_id"]).collect()
    assert len(got) == 305 and all(0 <= r["score"] <= 1 for r in got)
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert np.mean([(by_id[i] >= 0.5) == (i % 2 == 0) for i in held]) > 0.95
    assert by_id[5000] == by_id[5001]
    for some in (labels.where("quality = 1"), labels.limit(0)):
        assert all(0 < r["score"] < 1 for r in quality.score(docs, quality.train(docs, some), ["doc_id"]).collect())
    assert quality.score(docs.limit(0), model, ["doc_id"]).count() == 0


def test_fit_equals_gradient_descent_on_explicit_embeddings():
    """Softmax regression on averaged embeddings, with the gradient of each minibatch written out over dense matrices."""
    rng = random.Random(5)
    texts = [words(rng, rng.randint(1, 30)) + ("!!" if i % 2 else "") for i in range(23)] + [""]
    labels = [1 - i % 2 for i in range(24)]
    rows, width, epochs, size, rate, seed = 128, 4, 3, 5, 0.5, 9
    model = quality.fit(texts, labels, rows=rows, width=width, epochs=epochs, batch=size, rate=rate, seed=seed, least_steps=0)
    x = np.array([np.bincount(quality.tokens(t, rows), minlength=rows) / max(1, len(quality.tokens(t, rows))) for t in texts])
    draw = np.random.default_rng(seed)
    e, w, b = draw.uniform(-1 / width, 1 / width, (rows, width)), np.zeros((width, 2)), np.zeros(2)
    dealt = draw.permutation(24)
    batches = [dealt[i : i + size] for i in range(0, 24, size)]
    order = [i for _ in range(epochs) for i in draw.permutation(len(batches))]
    for step, i in enumerate(order):
        some, speed = batches[i], rate * (1 - step / len(order))
        grad_e, grad_w, grad_b = np.zeros_like(e), np.zeros_like(w), np.zeros_like(b)
        for d in some:
            h = x[d] @ e
            p = np.exp(h @ w + b) / np.exp(h @ w + b).sum()
            miss = p - np.eye(2)[labels[d]]
            grad_e += np.outer(x[d], w @ miss)
            grad_w += np.outer(h, miss)
            grad_b += miss
        e, w, b = e - 10 * speed * grad_e, w - 0.1 * speed * grad_w, b - 0.01 * speed * grad_b
    for t, row in zip(texts, x, strict=True):
        z = row @ e @ w + b
        assert model.score(t) == pytest.approx(1 / (1 + np.exp(z[0] - z[1])), rel=1e-3)
    assert np.abs(model.logits - e @ (w[:, 1] - w[:, 0])).max() < 1e-3


def test_tokens_are_words_pairs_of_words_and_character_runs():
    def count(text):
        w, padded = text.split(), f" {text} "
        return len(w) + max(0, len(w) - 1) + sum(max(0, len(padded) - n + 1) for n in quality.ORDERS)

    for t in ("a", "one two", "one  two\tthree", "word " * 50 + "end"):
        assert len(quality.tokens(t)) == count(t)
    same = quality.tokens("aa aa aa", 1 << 24)
    assert (same[0] == same[1] == same[2]) and same[3] == same[4] != quality.tokens("bb bb", 1 << 24)[2]


def test_labels_without_documents_take_no_place(spark):
    docs = spark.range(0, 400).select("id", F.concat(F.lit("text of "), "id").alias("text")).withColumnRenamed("id", "doc_id")
    labels = spark.range(-20_000, 400).select(F.col("id").alias("doc_id"), (F.col("id") % 2 == 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    seen = {}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(quality, "fit_packed", lambda docs, labels, rows, **_: seen.update(n=len(docs), labels=labels))
        quality.train(docs, labels, sample=200)
        assert seen["n"] == 200 and 50 < sum(seen["labels"]) < 150
        quality.train(docs, labels, sample=200, most_entries=1000)
        assert 0 < seen["n"] < 60


def test_unequal_texts_of_an_id_are_learned_alike(spark):
    rows = [(i % 20, f"text {i} " * (1 + i % 3)) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    found = []
    for parts, some in ((1, rows), (5, rows[::-1])):
        model = quality.train(spark.createDataFrame(some, "doc_id long, text string").repartition(parts), labels)
        found.append((model.offset, model.logits.tobytes()))
    assert found[0] == found[1]


def test_long_texts_are_learned_from(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, words(rng, 60_000, "ab" if i % 2 else "cd"), "xx" if i % 2 else "yy") for i in range(8)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(8)], "doc_id long, quality int, toxic int")
    assert sorted(langid.train(docs).languages) == ["xx", "yy"]
    assert langid.train(docs).weights.any() and quality.train(docs, labels).logits.any()
