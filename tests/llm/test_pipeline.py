import random

from pyspark.sql import functions as F
from tessera.llm import langid, mixing, ngram_join, quality
from tessera.llm.common import fresh_dir

import corpus_pipeline

from .fixtures import odd_documents, words


def stored(spark, docs, labels):
    at = fresh_dir(spark, "tables")
    docs.write.parquet(f"{at}/documents.parquet")
    labels.write.parquet(f"{at}/labels.parquet")
    return at


def test_stages_keep_columns_and_take_effect(spark):
    docs = odd_documents(spark).withColumn("_text", F.lit(1))
    rng = random.Random(3)
    labels = spark.createDataFrame([(i, int(rng.random() < 0.9), 0) for i in range(60)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    at = stored(spark, docs, labels)
    now = spark.read.parquet(f"{at}/documents.parquet")
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, at)
        last = number == len(corpus_pipeline.STAGES) - 1
        if not last:
            assert out.columns == docs.columns, name
        path = fresh_dir(spark, "stage")
        out.write.parquet(path)
        before, now = now, spark.read.parquet(path)
        if name.startswith("n-gram"):
            classes = {r["class_id"] for r in ngram_join.join(before).select("class_id").collect()}
            assert now.count() == len(classes) < before.count()
        if name.startswith("mixing"):
            copies = {r["doc_id"]: r["n"] for r in now.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
            want = {r["_row"]["doc_id"]: r["_copies"] for r in mixing.mix(before, mixing.words(F.col("text"))).collect()}
            assert copies == {k: v for k, v in want.items() if v}
        if last:
            assert now.where("start = 0").count() == before.count()
    first = [r["text"] for r in corpus_pipeline.STAGES[0][1](spark, docs, at).collect()]
    assert all(t and any(map(str.isalpha, t)) for t in first) and len(first) < docs.count()


def test_run_of_empty_tables(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert corpus_pipeline.run(spark, stored(spark, docs.limit(0), labels)).count() == 0
    assert words(random.Random(1), 3)


def python_bytes(df):
    """Bytes sent to and got from Python workers in a run of the frame's own plan, without what it was trained on."""
    run = df._jdf.queryExecution()
    run.toRdd().count()
    sent, got, nodes = 0, 0, [run.executedPlan()]
    for node in nodes:
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        if node.metrics().contains("pythonDataSent"):
            sent += node.metrics().apply("pythonDataSent").value()
            got += node.metrics().apply("pythonDataReceived").value()
    return sent, got


def test_classifiers_send_each_text_once_and_get_no_rows_back(spark):
    rng = random.Random(5)
    rows = [(i, words(rng, 400), "en" if i % 3 else "de", "a", "x" * 2000) for i in range(400)] + [(i, t, "en", None, None) for i, t in ((400, None), (401, ""), (401, "9 9"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, more string").repartition(2)
    at = stored(spark, docs, spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int"))
    docs = spark.read.parquet(f"{at}/documents.parquet")
    texts = sum(len(r[1] or "") for r in rows)
    found = langid.identify(docs, langid.train(docs), ["doc_id"]).where(F.col("lang_pred") != langid.UNKNOWN)
    judged = quality.score(docs, quality.train(docs, spark.read.parquet(f"{at}/labels.parquet")), ["doc_id"]).where(F.col("score") >= corpus_pipeline.LEAST_QUALITY)
    for (name, stage), kept in zip(corpus_pipeline.STAGES[:2], (found, judged), strict=True):
        out = stage(spark, docs, at)
        assert out.schema == docs.schema, name
        assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in kept.collect()), name
        sent, got = python_bytes(out.select("*"))
        assert texts < sent < 1.3 * texts, name
        assert 0 < got < 100 * len(rows), name
