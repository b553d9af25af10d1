from pyspark.sql import functions as F

from tessera.streaming import incremental


def drain(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_resume_adds_only_what_is_missing(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    schema = "k int, v string"
    for rows in ([(1, "a"), (2, "b"), (2, "b")], [(2, "again"), (3, "c")]):
        write(spark, rows, schema, src)
        incremental.resume(spark.readStream.schema(schema).parquet(src), ["k"], out, str(tmp_path / "ck")).awaitTermination(120)
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    # Run again from nothing: the table already has every key.
    incremental.resume(spark.readStream.schema(schema).parquet(src), ["k"], out, str(tmp_path / "ck2")).awaitTermination(120)
    assert spark.read.parquet(out).count() == 3


def test_halves_pair_across_batches(spark, tmp_path):
    src, schema = str(tmp_path / "src"), "pair string, role string, t string"
    write(spark, [("p", "chosen", "a"), ("q", "rejected", "z"), ("r", "chosen", "x"), ("r", "rejected", "y")], schema, src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    write(spark, [("p", "rejected", "b")], schema, src)
    got = drain(incremental.pair_halves(stream, ["pair"], "role", "t"), "halves")
    assert sorted((r["pair"], r["chosen"], r["rejected"]) for r in got) == [("p", "a", "b"), ("r", "x", "y")]


def test_running_counts_equal_the_batch(spark, tmp_path):
    src, schema = str(tmp_path / "src"), "ts timestamp, k string, value double"
    rows = spark.range(500).select((F.lit("2024-01-01").cast("timestamp") + F.expr("make_interval(0, 0, 0, 0, 0, cast(id as int))")).alias("ts"), (F.col("id") % 3).cast("string").alias("k"), F.col("id").cast("double").alias("value"))
    rows.coalesce(1).write.parquet(src)
    got = drain(incremental.running_counts(spark.readStream.schema(schema).parquet(src), "ts", ["k"], "1 hour", "10 minutes"), "counts", "complete")
    want = rows.groupBy(F.window("ts", "1 hour"), "k").agg(F.count("*").alias("n"), F.sum("value").alias("total")).collect()
    assert sorted((r["k"], r["window"]["start"], r["n"], r["total"]) for r in got) == sorted((r["k"], r["window"]["start"], r["n"], r["total"]) for r in want)
