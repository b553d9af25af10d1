"""Sources, sinks, streams, samples and statistics that no other query covers: what is written is read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import spans, text
from ..operators import joins, sampling, stats, style
from ..sources import provider
from ..sources import records as R
from ..sources import sinks
from ..storage import cut, fresh_dir
from ..streaming import incremental
from . import corpus_plans as C
from .base import PLAIN, TOKENS, documents, query, table


def _written(spark, d, name, write, kind):
    """A table written to the shared folder; its path."""
    at = f"{fresh_dir(spark, name)}/table.{kind}"
    write(table(spark, d, name), at)
    return at


# Sources


@query("s01_numbered_lines", "SELECT count(*) AS n, 0::BIGINT AS first, count(*) - 1 AS last, count(*) AS numbers, sum(len(text))::BIGINT AS chars FROM documents")
def s01(spark, d):
    """Several files, each with blank lines: rows are numbered without gaps."""
    at = f"{fresh_dir(spark, 'lines')}/documents.jsonl"
    lines = table(spark, d, "documents").repartition(6, "doc_id").select(F.explode(F.array(F.to_json(F.struct("doc_id", "text")), F.lit("  "))).alias("value"))
    lines.write.text(at)
    i = F.col("row_index")
    return R.jsonl(spark, at).agg(F.count("*").alias("n"), F.min(i).alias("first"), F.max(i).alias("last"), F.count_distinct(i).alias("numbers"), F.sum(F.length(F.try_variant_get("raw", "$.text", "string"))).alias("chars"))


@query("s02_source_rows", "SELECT doc_id AS id, md5(text) AS digest, lang FROM documents")
def s02(spark, d):
    raw = R.read_source(spark, _written(spark, d, "documents", sinks.write_table, "parquet"))
    return raw.select(*[F.try_variant_get("raw", f"$.{c}", t).alias(n) for c, t, n in (("doc_id", "bigint", "id"), ("lang", "string", "lang"))], F.md5(F.try_variant_get("raw", "$.text", "string")).alias("digest"))


@query("s03_sources_by_suffix", "SELECT kind, count(*) AS n, count(*) AS numbers FROM nation, (SELECT unnest(['csv', 'jsonl', 'parquet']) AS kind) GROUP BY kind")
def s03(spark, d):
    out = None
    for kind, write in (("csv", sinks.write_table), ("jsonl", sinks.write_jsonl), ("parquet", sinks.write_table)):
        rows = R.read_source(spark, _written(spark, d, "nation", write, kind)).select(F.lit(kind).alias("kind"), "row_index")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("row_index").alias("numbers"))


@query("s06_csv_cells", "SELECT c_custkey::VARCHAR AS c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance, c_mktsegment FROM customer")
def s06(spark, d):
    at = f"{fresh_dir(spark, 'cells')}/customer.csv"
    sinks.write_csv(table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("c_acctbal"), "c_mktsegment"), at)
    return R.csv_strings(spark, at).select("c_custkey", R.number("c_acctbal").alias("balance"), "c_mktsegment")


@query("s09_range_of_clustered", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_orderkey >= 100 AND l_orderkey < 300")
def s09(spark, d):
    at = f"{fresh_dir(spark, 'clustered')}/lineitem"
    sinks.write_clustered(table(spark, d, "lineitem"), at, ["l_orderkey", "l_linenumber"], 8)
    return R.row_range(spark.read.parquet(at), "l_orderkey", 100, 300, ["l_orderkey", "l_quantity"])


@query("n02_coerced", "SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN nullif(trim(min(text) FILTER (WHERE turn = t0), E' \\t\\n\\r'), '') WHEN 1 THEN string_agg(nullif(trim(text, E' \\t\\n\\r'), ''), E'\\n' ORDER BY turn) ELSE nullif(trim(min(text) FILTER (WHERE turn = t0), E' \\t\\n\\r'), '') END AS found FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS t0 FROM conversations) GROUP BY conv_id")
def n02(spark, d):
    """A string, a list of strings, and a map."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda m: m["text"])
    chats = table(spark, d, "conversations").groupBy("conv_id").agg(texts.alias("t"))
    shapes = F.array(F.to_json(F.struct(F.col("t")[0].alias("v"))), F.to_json(F.struct(F.col("t").alias("v"))), F.to_json(F.struct(F.struct(F.col("t")[0].alias("content")).alias("v"))))
    raw = F.parse_json(F.element_at(shapes, (F.col("conv_id") % 3 + 1).cast("int")))
    return chats.select("conv_id", raw.alias("raw")).select("conv_id", R.coerced(F.col("raw"), "$.v").alias("found"))


@query("n04_record_ids", "SELECT doc_id AS row_index, CASE doc_id % 3 WHEN 0 THEN 'u' || doc_id WHEN 1 THEN 'docs:train:' || doc_id ELSE 'docs:none:' || doc_id END AS record_id FROM documents")
def n04(spark, d):
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select(i.alias("row_index"), F.parse_json(F.to_json(F.struct(F.when(i % 3 == 0, F.concat(F.lit("u"), i.cast("string"))).alias("uid")))).alias("raw"))
    ids = [R.record_id(F.col("raw"), ["id", "uid"], "docs", split, F.col("row_index")) for split in ("train", None)]
    return rows.select("row_index", F.when(F.col("row_index") % 3 == 2, ids[1]).otherwise(ids[0]).alias("record_id"))


_SCANS = {"license": "GNU [A-Za-z ]+ License", "mark": "[a-z]+%%%", "shout": "[A-Z]{3,}!!"}


@query("s14_text_scans", "WITH l AS (SELECT doc_id, unnest(string_split(text, E'\\n')) AS l, unnest(range(1, len(string_split(text, E'\\n')) + 1)) AS line FROM documents) SELECT doc_id, line::INT AS line, 'license' AS kind, unnest(regexp_extract_all(l, 'GNU [A-Za-z ]+ License')) AS hit FROM l UNION ALL SELECT doc_id, line::INT, 'mark', unnest(regexp_extract_all(l, '[a-z]+%%%')) FROM l UNION ALL SELECT doc_id, line::INT, 'shout', unnest(regexp_extract_all(l, '[A-Z]{3,}!!')) FROM l")
def s14(spark, d):
    return R.text_scans(documents(spark, d), "doc_id", "text", _SCANS)


# Sinks


@query("k01_json_lines", "SELECT doc_id, lang, md5(text) AS digest, '{\"doc_id\":' || doc_id || ',\"lang\":' AS head FROM documents")
def k01(spark, d):
    at = f"{fresh_dir(spark, 'json')}/documents"
    sinks.write_jsonl(table(spark, d, "documents").select("text", "lang", "doc_id"), at)
    r = F.from_json("value", "doc_id long, lang string, text string")
    return spark.read.text(at).select(r.alias("r"), "value").select("r.doc_id", "r.lang", F.md5("r.text").alias("digest"), F.concat(F.regexp_extract("value", "^[^,]*,", 0), F.regexp_extract("value", '^[^,]*,("lang":)', 1)).alias("head"))


@query("k02_csv_columns", "SELECT 's_nationkey,s_acctbal,s_name,s_suppkey' AS header, count(*) AS n, sum(s_suppkey)::BIGINT AS keys FROM supplier")
def k02(spark, d):
    at = f"{fresh_dir(spark, 'csv')}/supplier.csv"
    sinks.write_csv(table(spark, d, "supplier"), at, ["s_nationkey"])
    rows = spark.read.csv(at, header=True)
    return rows.agg(F.lit(",".join(rows.columns)).alias("header"), F.count("*").alias("n"), F.sum(F.col("s_suppkey").cast("long")).alias("keys"))


@query("k03_table_by_suffix", "SELECT kind, n_nationkey, n_name FROM nation, (SELECT unnest(['csv', 'parquet']) AS kind)")
def k03(spark, d):
    as_csv, as_parquet = (_written(spark, d, "nation", sinks.write_table, k) for k in ("csv", "parquet"))
    both = {"csv": spark.read.csv(as_csv, header=True), "parquet": spark.read.parquet(as_parquet)}
    a, b = (df.select(F.lit(k).alias("kind"), F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name") for k, df in both.items())
    return a.unionByName(b)


@query("k04_report", "SELECT r_regionkey, r_name, 5::BIGINT AS rows FROM region")
def k04(spark, d):
    made = sinks.report(table(spark, d, "region"), {"rows": 5})
    r = F.from_json(F.lit(made), "summary struct<rows:long>, records array<struct<r_regionkey:int,r_name:string>>")
    return spark.range(1).select(r.alias("r")).select(F.explode("r.records").alias("x"), "r.summary.rows").select("x.r_regionkey", "x.r_name", "rows")


@query("k05_markdown", "SELECT '| r_regionkey | r_name |' AS line UNION ALL SELECT '|---|---|' UNION ALL SELECT '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region")
def k05(spark, d):
    return spark.createDataFrame([(x,) for x in sinks.markdown(table(spark, d, "region").select("r_regionkey", "r_name")).splitlines()], "line string")


@query("k06_clustered", "SELECT o_custkey, count(*) AS n, sum(o_totalprice * 100)::DECIMAL(18, 0)::BIGINT AS cents FROM orders GROUP BY o_custkey")
def k06(spark, d):
    at = f"{fresh_dir(spark, 'clustered')}/orders"
    sinks.write_clustered(table(spark, d, "orders"), at, ["o_custkey"], 5)
    return spark.read.parquet(at).groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))


@query("k08_tracked", "SELECT doc_id, lang, source, n_chars, len(text)::INT AS text_chars FROM documents ORDER BY doc_id LIMIT 1000")
def k08(spark, d):
    return sinks.tracked(table(spark, d, "documents"), ["text"], ["doc_id"])


@query("k11_manifest", "SELECT count(*)::BIGINT AS lines, true AS digests_fit FROM documents")
def k11(spark, d):
    at = f"{fresh_dir(spark, 'manifest')}/documents.jsonl"
    sinks.write_jsonl(table(spark, d, "documents").select("doc_id", "source").repartition(3), at)
    # Files of a folder have the suffix of their writer; the manifest counts lines of the suffixes it knows.
    files = sinks.manifest(spark, at, "part-*.txt")
    again = spark.read.format("binaryFile").load(at).select("path", F.sha2("content", 256).alias("s"))
    return files.join(again, "path").agg(F.sum("lines").alias("lines"), F.bool_and(F.col("sha256") == F.col("s")).alias("digests_fit"))


@query("t11_clustered_order", "SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS last FROM lineitem GROUP BY l_orderkey HAVING count(*) = max(l_linenumber)")
def t11(spark, d):
    """Complete orders of a table clustered by order and line."""
    at = f"{fresh_dir(spark, 'clustered')}/lineitem"
    sinks.write_clustered(table(spark, d, "lineitem"), at, ["l_orderkey", "l_linenumber"], 8)
    by_order = spark.read.parquet(at).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_linenumber").alias("last"))
    return by_order.where("n = last")


# Streams


def _stream(spark, d, name, *columns):
    df = table(spark, d, name).select(*columns)
    at = f"{fresh_dir(spark, 'stream')}/{name}"
    df.repartition(3).write.parquet(at)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(at)


@query("r01_resumed", "SELECT DISTINCT user_id, event_type FROM events")
def r01(spark, d):
    """A stream appended twice: keys that are there are not written again."""
    out, marks = f"{fresh_dir(spark, 'resumed')}/table", fresh_dir(spark, "marks")
    for run in range(2):
        incremental.resume(_stream(spark, d, "events", "user_id", "event_type"), ["user_id", "event_type"], out, f"{marks}/{run}").awaitTermination()
    return spark.read.parquet(out).select("user_id", "event_type")


@query("r02_paired_halves", "SELECT conv_id, turn // 2 AS k, md5(max(text) FILTER (WHERE role = 'user')) AS chosen, md5(max(text) FILTER (WHERE role = 'assistant')) AS rejected FROM conversations WHERE role IN ('user', 'assistant') GROUP BY ALL HAVING count(DISTINCT role) = 2 AND count(*) = 2")
def r02(spark, d):
    """User and assistant of a turn, met in any order over several batches."""
    halves = table(spark, d, "conversations").where("role in ('user', 'assistant')").select("conv_id", F.floor(F.col("turn") / 2).alias("k"), F.when(F.col("role") == "user", "chosen").otherwise("rejected").alias("role"), F.md5("text").alias("t"))
    at, out, marks = (fresh_dir(spark, n) for n in ("halves", "pairs", "marks"))
    halves.repartition(3).write.parquet(at)
    stream = spark.readStream.schema(halves.schema).option("maxFilesPerTrigger", 1).parquet(at)
    met = incremental.pair_halves(stream, ["conv_id", "k"], "role", "t")
    met.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("conv_id long, k long, chosen string, rejected string").parquet(out)


@query("r03_running_counts", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def r03(spark, d):
    """Counters by hour, updated batch by batch; the last update of each counts."""
    out, marks = f"{fresh_dir(spark, 'counts')}/table", fresh_dir(spark, "marks")
    counts = incremental.running_counts(_stream(spark, d, "events", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value"), "ts", ["event_type"], "1 hour", "3650 days")

    def keep(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(out).groupBy("window", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("x"))
    return last.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "x.n", F.round("x.total", 6).alias("total"))


@query("r04_job_progress", "WITH s AS (SELECT event_type, min(event_id) AS first_step, max(event_id) AS last_step, date_diff('second', min(ts), max(ts)) AS seconds, 2000::BIGINT AS total FROM events GROUP BY 1), r AS (SELECT *, (last_step - first_step)::DOUBLE / nullif(seconds, 0) AS rate FROM s) SELECT event_type, last_step, total, round(rate, 9) AS steps_per_second, round(CASE WHEN total <= last_step THEN 0 ELSE (total - last_step) / nullif(rate, 0) END, 3)::DOUBLE AS seconds_left, CASE WHEN total <= last_step THEN 'complete' WHEN rate > 0 THEN 'running' ELSE 'stalled' END AS state FROM r")
def r04(spark, d):
    found = incremental.progress(table(spark, d, "events"), "event_type", "ts", "event_id", F.lit(2000).cast("long"))
    return found.withColumn("steps_per_second", F.round("steps_per_second", 9)).withColumn("seconds_left", F.round("seconds_left", 3))


# A model's place


def _comma_share():
    """Stands for a detector: its score is the share of commas."""
    import pyarrow as pa

    def score(batch):
        texts = batch.column("text").to_pylist()
        return pa.RecordBatch.from_arrays([pa.array([t.count(",") / max(1, len(t)) for t in texts], pa.float64())], names=["probability"])

    return score


@query("g04_detector_batches", "SELECT doc_id, CASE WHEN quality = 0 THEN -1 ELSE round(len(regexp_extract_all(text, ',')) / greatest(1, len(text))::DOUBLE, 12) END AS probability FROM documents LEFT JOIN labels USING (doc_id)")
def g04(spark, d):
    """Scores in batches, resumed: documents of low quality have one already, which stays."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    known = docs.join(table(spark, d, "labels").where("quality = 0").select("doc_id"), "doc_id").withColumn("probability", F.lit(-1.0))
    return provider.scored_in_batches(docs, "detector", _comma_share, "probability double", known, ["doc_id"]).select("doc_id", F.round("probability", 12).alias("probability"))


# Filters, joins, samples and statistics


@query("f07_kept_phrases", C._GRAMS + " SELECT doc_id, count(*) AS kept FROM k GROUP BY doc_id")
def f07(spark, d):
    grams = F.concat(text.ngrams(F.col("w"), 1), text.ngrams(F.col("w"), 2))
    return C._english(spark, d).select("doc_id", F.explode(grams).alias("g")).where(~text.skipped(F.col("g"))).groupBy("doc_id").agg(F.count("*").alias("kept"))


@query("f08_support", C._GRAMS + """, t AS (SELECT side, sum(len(w))::BIGINT AS tokens FROM w GROUP BY side),
j AS (SELECT phrase, coalesce(max(count) FILTER (WHERE side = 'model'), 0) AS mc, coalesce(max(docs) FILTER (WHERE side = 'model'), 0) AS md, coalesce(max(count) FILTER (WHERE side = 'reference'), 0) AS rc FROM c GROUP BY phrase),
x AS (SELECT phrase, mc, md, rc, (SELECT tokens FROM t WHERE side = 'model') AS mt, (SELECT tokens FROM t WHERE side = 'reference') AS rt, (SELECT count(*) FROM j) AS v FROM j)
SELECT phrase, mc AS model_count, md AS model_docs FROM x WHERE mc >= 6 AND md >= 4 AND ((mc + 0.5::DOUBLE) / (mt + 0.5::DOUBLE * v)) / ((rc + 0.5::DOUBLE) / (rt + 0.5::DOUBLE * v)) >= 1.2""")
def f08(spark, d):
    docs = C._english(spark, d)
    counts = style.corpus_counts(docs, "side", "doc_id", F.col("w"), (1, 2), 1)
    totals = docs.groupBy("side").agg(F.sum(F.size("w")).alias("tokens"), F.count("*").alias("docs"))
    return style.lift(counts, totals, "side", "model", "reference", 6, 4, 1.2).select("phrase", "model_count", "model_docs")


@query("j12_exact_else_proxy", "WITH e AS (SELECT DISTINCT c_nationkey AS source, 'exact' AS target FROM customer WHERE c_nationkey < 9), p AS (SELECT s_nationkey AS source, 'proxy' || min(s_suppkey) AS target FROM supplier GROUP BY 1) SELECT n_nationkey AS source, coalesce(e.target, p.target) AS target, e.target IS NOT NULL AS exact FROM nation LEFT JOIN e ON n_nationkey = e.source LEFT JOIN p ON n_nationkey = p.source WHERE coalesce(e.target, p.target) IS NOT NULL")
def j12(spark, d):
    exact = table(spark, d, "customer").where("c_nationkey < 9").select(F.col("c_nationkey").alias("source"), F.lit("exact").alias("target")).distinct()
    proxy = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("source")).agg(F.concat(F.lit("proxy"), F.min("s_suppkey").cast("string")).alias("target"))
    return joins.exact_else_proxy(table(spark, d, "nation").select(F.col("n_nationkey").alias("source")), exact, proxy)


@query("t17_prompts_by_hash", "SELECT conv_id, turn FROM conversations WHERE role = 'user' ORDER BY sha256('5' || chr(0) || conv_id::VARCHAR || chr(0) || turn::VARCHAR), conv_id * 1000 + turn LIMIT 40")
def t17(spark, d):
    prompts = table(spark, d, "conversations").where("role = 'user'").withColumn("at", F.col("conv_id") * 1000 + F.col("turn"))
    return sampling.prompt_sample(prompts, "hash", 40, "at", "conv_id", "turn", 5).select("conv_id", "turn")


_TIES = "round(value)"


@query("w02_average_ranks", f"SELECT event_id, rank() OVER (ORDER BY {_TIES}) + (count(*) OVER (PARTITION BY {_TIES}) - 1) / 2.0::DOUBLE AS rank, rank() OVER (PARTITION BY event_type ORDER BY {_TIES}) + (count(*) OVER (PARTITION BY event_type, {_TIES}) - 1) / 2.0::DOUBLE AS rank_of_type FROM events")
def w02(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", F.round("value").alias("v"))
    return stats.with_average_rank(stats.with_average_rank(e, "v", "rank"), "v", "rank_of_type", ["event_type"]).select("event_id", "rank", "rank_of_type")


@query("q02_overall_discovery", "WITH p AS (SELECT o_orderkey, (o_orderkey * 7919 % 100003) / 100003.0::DOUBLE AS p FROM orders), r AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM p) SELECT o_orderkey, round(least(1.0::DOUBLE, min(p * m / r) OVER (ORDER BY r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 12) AS q_value FROM r")
def q02(spark, d):
    p = (F.col("o_orderkey") * 7919 % 100003) / F.lit(100003.0)
    return stats.false_discovery(table(spark, d, "orders").select("o_orderkey", p.alias("p_value"))).select("o_orderkey", F.round("q_value", 12).alias("q_value"))


def _resampled_rates(spark, d, keys, cluster, replicates):
    by = documents(spark, d).groupBy(*keys, cluster).agg(F.sum(text.tokens(F.col("text"))).alias("tokens"), F.count("*").alias("docs"), F.sum(F.regexp_count("text", F.lit(","))).cast("long").alias("commas"))
    drawn = stats.resampled(by, keys, cluster, ["tokens", "docs", "commas"], replicates)
    return drawn.withColumn("rate", text.rate(F.col("commas"), F.col("tokens"))).withColumn("length", text.safe_ratio(F.col("tokens").cast("double"), F.col("docs").cast("double")))


@query("q04_cluster_intervals")
def q04(spark, d):
    return stats.intervals(_resampled_rates(spark, d, ["lang"], "source", 100), ["lang"], ["rate", "length"])


@query("q06_prompt_intervals")
def q06(spark, d):
    turns = table(spark, d, "conversations").groupBy("role", "conv_id").agg(F.sum(text.words(F.col("text"))).alias("words"), F.count("*").alias("turns"))
    drawn = stats.resampled(turns, ["role"], "conv_id", ["words", "turns"], 100).withColumn("length", F.col("words") / F.nullif(F.col("turns"), F.lit(0)))
    return stats.intervals(drawn, ["role"], ["length"])


@query("q08_score_intervals")
def q08(spark, d):
    """Intervals of a benchmark score over counters of outputs."""
    w = documents(spark, d).select("lang", "doc_id", text.benchmark_tokens(F.col("text")).alias("w"))
    counted = w.select("lang", "doc_id", F.size("w").cast("long").alias("words"), text.listed(F.col("w"), ("the", "of", "an", "hand")).alias("hits"))
    drawn = stats.resampled(counted, ["lang"], "doc_id", ["words", "hits"], 100)
    score = text.weighted_score(text.safe_rate(F.col("hits").cast("double") * 1000.0, F.col("words")), F.lit(0.0), F.lit(0.0))
    return stats.intervals(drawn.withColumn("score", score), ["lang"], ["score"])


# Text


_FOLDED = TOKENS.removeprefix("len(").removesuffix(")").replace("(text,", "(replace(lower(text), 'ß', 'ss'),")


@query("x27_shingles", f"WITH w AS (SELECT conv_id, turn, {_FOLDED} AS w FROM conversations) SELECT conv_id, turn, CASE WHEN len(w) = 0 THEN 0 ELSE len(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS shingles FROM w")
def x27(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", spans.shingle_count(5)(F.col("text")).alias("shingles"))


@query("x30_bands", f"SELECT conv_id, turn, CASE WHEN {TOKENS} > 0 THEN 4 ELSE 0 END::BIGINT AS bands, CASE WHEN {TOKENS} > 0 THEN 67 END AS length FROM conversations WHERE role = 'user'")
def x30(spark, d):
    """18 hashes make four bands of four, each as long as four digests and three marks; the rest is dropped."""
    b = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", spans.minhash_function(18)(F.col("text")).alias("s"))
    b = cut(b).withColumn("b", spans.bands(F.col("s")))
    return b.select("conv_id", "turn", F.size("b").cast("long").alias("bands"), F.array_max(F.transform("b", lambda x: F.length(x["band"]))).alias("length"))


@query("x32_labelled_opportunities", f"SELECT doc_id, {TOKENS} AS opportunities, len(regexp_extract_all({PLAIN}, '(?i)\\bof\\s+the\\b')) AS initiated FROM documents")
def x32(spark, d):
    o = documents(spark, d).select("doc_id", spans.opportunity_function(("neutral_common_of_the",))(F.col("text")).alias("o"))
    return o.select("doc_id", F.size("o").cast("long").alias("opportunities"), F.size(F.filter("o", lambda x: x["initiates"])).cast("long").alias("initiated"))
