"""Copies of a text take one place of the training sample."""

from pyspark.sql import functions as F
from tessera.llm import langid


def test_sample_counts_texts_not_rows(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(langid, "fit_presence", lambda present, labels, **_: seen.update(present=present))
    texts = spark.range(40).select(F.concat(F.lit("some text "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"))
    hot = texts.orderBy(F.xxhash64("text")).limit(1)
    rows = texts.crossJoin(spark.range(30)).join(hot, "text", "left_semi").select("text").unionByName(texts)
    docs = rows.select(F.lit(1).cast("long").alias("doc_id"), "text", F.lit("en").alias("lang"))
    langid.train(docs, per_language=10, sample=8)
    assert len({x.tobytes() for x in seen["present"]}) == len(seen["present"]) == 8


def test_copies_do_not_use_up_a_language(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(langid, "fit_presence", lambda present, labels, **_: seen.update(n=len(present)))
    texts = spark.range(600).select(F.concat(F.lit("english text "), F.col("id").cast("string")).alias("text"))
    docs = texts.unionByName(spark.range(3000).select(F.lit("english text 7").alias("text"))).select(F.lit(1).cast("long").alias("doc_id"), "text", F.lit("en").alias("lang"))
    langid.train(docs)
    assert seen["n"] == 400


def test_the_least_hashes_of_each_language_are_chosen(spark, monkeypatch):
    """With a language of many texts, one of few and copies, the sample is that of a full sort."""
    seen = {}
    monkeypatch.setattr(langid, "fit_presence", lambda present, labels, **_: seen.update(present=present, labels=labels))
    name = lambda n: F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")
    rows = [spark.range(n).select(F.concat(F.lit(f"{lang} "), name(n)).alias("text"), F.lit(lang).alias("lang")) for lang, n in (("many", 20_000), ("few", 30))]
    copies = spark.range(9000).select(F.lit("many a").alias("text"), F.lit("many").alias("lang"))
    docs = rows[0].unionByName(rows[1]).unionByName(copies).withColumn("doc_id", F.lit(1).cast("long"))
    langid.train(docs, per_language=40, sample=60)
    hashed = {lang: sorted((r["h"], r["text"]) for r in df.select("text", F.xxhash64("text").alias("h")).collect())[:40] for lang, df in zip(("many", "few"), rows, strict=True)}
    ranked = sorted((i, h, lang, t) for lang, some in hashed.items() for i, (h, t) in enumerate(some))[:60]
    want = sorted((lang, langid.presence(t).tobytes()) for _, _, lang, t in ranked)
    assert sorted((y, x.tobytes()) for x, y in zip(seen["present"], seen["labels"], strict=True)) == want
