"""G-9, G-2: searches for continuations that a detector scores high and a language model finds likely, as tables.

A beam is a table of states, a few rows for each prompt. A step looks up the likeliest next words of each different
context once, adds what the detector says of each word, and keeps the best states of each prompt. Steps are written
one by one and those that are there already are not made again, so a search that was stopped goes on where it was.

The likeliest words of a context are exact for the interpolated model: a word that was not seen after (u, v) has a
fixed share of its probability after v alone, so the first k after (u, v) are among the first k that were seen there
and the first k after v, and so on down. Only these are kept, k for each context.

The detector adds one logit for each class and word (any linear model; ``bucket_detector`` trains one by counts). Its
score is the mean class over the number of classes less one. Objectives are rounded to 9 digits before they are
compared, ties go to the lesser words, so reruns agree.

Defined cases: prompts have unique ids that are not null; null and empty prompts begin with start tokens; a state
without candidates ends, and a prompt whose states have all ended keeps those of its last step; no prompts or an
empty corpus give no rows. Columns of prompts other than id and text play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import quality_penalty
from ..storage import cut, fresh_dir
from .language_model import END, START, NgramModel, tokens

STATE = ["id", "beam_rank", "u", "v", "words", "log_p", "logits", "score", "penalty", "objective"]


def usable(word: Column, most_chars: int = 24, ascii_only: bool = True) -> Column:
    """Words of letters and digits up to a length, and marks of sentences."""
    letters = r"^[a-z0-9_]+$" if ascii_only else r"^[\p{L}\p{N}_]+$"
    return ~word.isin(START, END) & (word.isin(*".,;:!?") | (word.rlike(letters) & (F.length(word) <= most_chars)))


@dataclass
class Followers:
    """The first k words after each context: entries are (n, w) with n the negative probability, in order."""

    pairs: DataFrame  # u, v, share, first
    words: DataFrame  # v, share, first
    alone: list[tuple[float, str]]
    k: int


def _firsts(scored: DataFrame, totals: DataFrame, context: list[str], share: Column, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*context).orderBy(F.desc("p"), "w"))
    firsts = scored.withColumn("_r", rank).where(F.col("_r") <= k).groupBy(*context).agg(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("n"), "w"))).alias("first"))
    none = F.array().cast("array<struct<n: double, w: string>>")
    return cut(totals.select(*context, share.alias("share")).join(firsts, context, "left").withColumn("first", F.coalesce("first", none)))


def followers(model: NgramModel, k: int, allowed: Column | None = None) -> Followers:
    """allowed is a condition on a column w. Both tables have a row for each context of the model, with at most k words."""
    allowed = usable(F.col("w")) if allowed is None else allowed
    if not model.total:
        return Followers(model.levels[0].counts.select("u", "v").withColumns({"share": F.lit(1.0), "first": F.lit(None).cast("array<struct<n: double, w: string>>")}), model.levels[1].counts.select("v").withColumns({"share": F.lit(1.0), "first": F.lit(None).cast("array<struct<n: double, w: string>>")}), [], k)
    p = F.greatest(F.col("c") - F.lit(model.discount), F.lit(0.0)) / model.total + F.lit(model.unknown)
    lower = model.words.where(allowed).select("w", p.alias("q"))
    alone = [(-r["q"], r["w"]) for r in lower.orderBy(F.desc("q"), "w").limit(k).collect()]
    tables = []
    for level, on in ((model.levels[1], ["w"]), (model.levels[0], ["v", "w"])):
        share = F.lit(level.discount) * F.col("types") / F.col("total")
        own = F.greatest(F.col("c") - F.lit(level.discount), F.lit(0.0)) / F.col("total")
        scored = level.counts.where(allowed).join(level.totals, level.context).join(lower, on).select(*level.context, "w", (own + share * F.col("q")).alias("p"))
        scored = cut(scored) if len(on) == 1 else scored  # the longer level asks for the shorter one's again
        tables.append(_firsts(scored, level.totals, level.context, share, k))
        lower = scored.withColumnRenamed("p", "q")
    return Followers(tables[1], tables[0], alone, k)


def _merged(own: Column, other: Column, share: Column, k: int) -> Column:
    seen = F.transform(own, lambda x: x["w"])
    unseen = F.filter(other, lambda x: ~F.array_contains(seen, x["w"]))
    return F.slice(F.array_sort(F.concat(own, F.transform(unseen, lambda x: F.struct((x["n"] * share).alias("n"), x["w"].alias("w"))))), 1, k)


def likeliest(known: Followers, contexts: DataFrame) -> DataFrame:
    """The different (u, v) of a table with their first k words as choices, an array of (n, w)."""
    once = contexts.select("u", "v").distinct()
    near = known.pairs.join(once, ["u", "v"], "left_semi").withColumnsRenamed({"share": "_s3", "first": "_f3"})
    far = known.words.join(once.select("v"), "v", "left_semi").withColumnsRenamed({"share": "_s2", "first": "_f2"})
    alone = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(w).alias("w")) for n, w in known.alone]).cast("array<struct<n: double, w: string>>")
    second = F.when(F.col("_f2").isNull(), alone).otherwise(_merged(F.col("_f2"), alone, F.col("_s2"), known.k))
    out = once.join(far, "v", "left").withColumn("_second", second).join(near, ["u", "v"], "left")
    return out.select("u", "v", F.when(F.col("_f3").isNull(), F.col("_second")).otherwise(_merged(F.col("_f3"), F.col("_second"), F.col("_s3"), known.k)).alias("choices"))


@dataclass
class Detector:
    """weights: w and its logits, one for each class; words that are not there have those of unknown."""

    weights: DataFrame
    unknown: list[float]
    prior: list[float]


def bucket_detector(texts: DataFrame, text: str, bucket: str, classes: int, alpha: float = 1.0) -> Detector:
    """Naive Bayes over buckets 0 to classes - 1: smoothed counts of words. Rows of other buckets and of null ones are left out."""
    rows = texts.where(F.col(bucket).between(0, classes - 1)).select(F.col(bucket).cast("int").alias("b"), tokens(F.col(text)).alias("t"))
    at = lambda value, kind: [F.sum(F.when(F.col("b") == i, value).otherwise(0)).cast("double").alias(f"{kind}{i}") for i in range(classes)]
    docs = rows.agg(*at(F.lit(1), "d"), *at(F.size("t"), "n")).first()
    counts = cut(rows.select("b", F.explode("t").alias("w")).groupBy("w").agg(*at(F.lit(1), "c")))
    size = counts.count()
    below = [(docs[f"n{i}"] or 0.0) + alpha * (size + 1) for i in range(classes)]
    logs = [F.log((F.col(f"c{i}") + F.lit(alpha)) / F.lit(below[i])).alias(str(i)) for i in range(classes)]
    one = texts.sparkSession.range(1).select(*[F.log(F.lit(alpha / b)) for b in below], *[F.log(F.lit((docs[f"d{i}"] or 0.0) + 1.0)) for i in range(classes)]).first()
    return Detector(cut(counts.select("w", F.array(*logs).alias("logits"))), list(one[:classes]), list(one[classes:]))


def _array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def score(logits: Column, classes: int) -> Column:
    """The mean class under softmax, over classes - 1."""
    most = F.array_max(logits)
    shares = F.transform(logits, lambda x: F.exp(x - most))
    add = lambda a, x: a + x
    weighted = F.aggregate(F.transform(shares, lambda x, i: x * i), F.lit(0.0), add)
    return weighted / F.aggregate(shares, F.lit(0.0), add) / float(max(1, classes - 1))


def _begun(prompts: DataFrame, id_: str, text: str, detector: Detector) -> DataFrame:
    """The state of each prompt before the first word; the detector has read the prompt."""
    t = tokens(F.col(text))
    rows = prompts.select(F.col(id_).alias("id"), t.alias("t"))
    zero = _array([0.0] * len(detector.prior))
    words = rows.select("id", F.explode("t").alias("w")).groupBy("id", "w").agg(F.count("*").alias("n"))
    met = words.join(detector.weights, "w", "left").withColumn("logits", F.coalesce("logits", _array(detector.unknown)))
    sums = met.groupBy("id").agg(F.array(*[F.sum(F.col("n") * F.col("logits")[i]) for i in range(len(detector.prior))]).alias("_read"))
    full = F.concat(F.array(F.lit(START), F.lit(START)), F.col("t"))
    logits = F.zip_with(F.coalesce("_read", zero), _array(detector.prior), lambda a, b: a + b)
    out = rows.select("id", F.element_at(full, -2).alias("u"), F.element_at(full, -1).alias("v")).join(sums, "id", "left").withColumn("logits", logits)
    return out.select("id", F.lit(0).alias("beam_rank"), "u", "v", F.array().cast("array<string>").alias("words"), F.lit(0.0).alias("log_p"), "logits", score(F.col("logits"), len(detector.prior)).alias("score"), F.lit(0.0).alias("penalty"), F.lit(0.0).alias("objective"))


def _written(df: DataFrame, at: str) -> DataFrame:
    """Reads a step, and writes it before where it is not there whole."""
    spark = df.sparkSession
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def _expanded(states: DataFrame, known: Followers, detector: Detector, least_log_p: float | None, order: Callable[[Column], Column], most: int) -> DataFrame:
    """A row for each state and its first candidates by ``order``, a function of a struct of w, log_q and score: w, log_q, and the state's logits and score after w.

    The detector's words meet the different contexts; states then find candidates as one array, and no rows are made of those that go.
    """
    each = likeliest(known, states).select("u", "v", F.inline("choices"))
    if least_log_p is not None:
        each = each.where(F.log(-F.col("n")) >= least_log_p)
    met = each.join(detector.weights.withColumnRenamed("logits", "_l"), "w", "left").withColumn("_l", F.coalesce("_l", _array(detector.unknown)))
    choices = met.groupBy("u", "v").agg(F.collect_list(F.struct("w", F.log(-F.col("n")).alias("log_q"), F.col("_l").alias("l"))).alias("_c"))  # k at most
    found = states.join(choices, ["u", "v"])
    found = found.withColumn("_c", F.transform("_c", lambda c: F.struct(c["w"].alias("w"), c["log_q"].alias("log_q"), F.zip_with("logits", c["l"], lambda a, b: a + b).alias("logits"))))
    found = found.withColumn("_c", F.transform("_c", lambda c: F.struct(c["w"].alias("w"), c["log_q"].alias("log_q"), c["logits"].alias("logits"), score(c["logits"], len(detector.prior)).alias("score"))))
    ranked = F.transform("_c", lambda c: F.struct((-order(c)).alias("o"), c["w"].alias("w"), c["log_q"].alias("log_q"), c["logits"].alias("logits"), c["score"].alias("score")))
    kept = found.withColumn("_c", F.slice(F.array_sort(ranked), 1, most)).drop("logits", "score")
    return kept.select(*(c for c in kept.columns if c != "_c"), F.inline("_c")).drop("o")


def _after(found: DataFrame) -> DataFrame:
    return found.withColumns({"words": F.concat("words", F.array("w")), "log_p": F.col("log_p") + F.col("log_q"), "u": F.col("v"), "v": F.col("w")})


def search(prompts: DataFrame, id_: str, text: str, known: Followers, detector: Detector, steps: int, beams: int = 4, branches: int = 4, likelihood: float = 0.1, repetition: float = 0.1, quality: float = 0.0, least_log_p: float | None = None, at: str | None = None) -> DataFrame:
    """Beams of every step: id, step, beam_rank (0 is best), words, log_p, score, penalty, objective.

    Each state keeps its ``branches`` best candidates by score + likelihood * log probability - repetition * how often
    the word is in it; of these, each prompt keeps ``beams`` states by score + likelihood * mean log probability -
    repetition * share of repeated words - quality * quality_penalty of the words. ``at`` is a folder of this search
    alone, with these very arguments; a search stopped there goes on after its last whole step.
    """
    if beams < 1 or branches < 1 or steps < 1:
        raise ValueError("beams, branches and steps must be positive")
    at = at or fresh_dir(prompts.sparkSession, "beam")
    states = _written(_begun(prompts, id_, text, detector).select(*STATE), f"{at}/step=0")
    every = []
    for step in range(1, steps + 1):
        again = lambda w: F.size(F.filter("words", lambda x: x == w))
        choice = lambda c: F.round(c["score"] + likelihood * c["log_q"] - repetition * again(c["w"]), 9)  # noqa: B023, E731
        kept = _after(_expanded(states, known, detector, least_log_p, choice, branches))
        n = F.size("words")
        kept = kept.withColumn("penalty", quality_penalty(F.array_join("words", " ")) if quality else F.lit(0.0))
        objective = F.col("score") + likelihood * F.col("log_p") / n - repetition * (n - F.size(F.array_distinct("words"))) / n - quality * F.col("penalty")
        rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("objective"), "words")) - 1
        best = kept.withColumn("objective", F.round(objective, 9)).withColumn("beam_rank", rank).where(F.col("beam_rank") < beams)
        states = _written(best.select(*STATE), f"{at}/step={step}")
        every.append(states.withColumn("step", F.lit(step)))
    out = every[0]
    for more in every[1:]:
        out = out.unionByName(more)
    return out.select(F.col("id").alias(id_), "step", "beam_rank", "words", "log_p", "score", "penalty", "objective")


def last_beams(found: DataFrame, id_: str) -> DataFrame:
    """The states of each prompt's last step."""
    return found.withColumn("_last", F.max("step").over(Window.partitionBy(id_))).where(F.col("step") == F.col("_last")).drop("_last")


def sampled(prompts: DataFrame, id_: str, text: str, known: Followers, detector: Detector, steps: int, samples: int = 4, temperature: float = 1.0, seed: int = 13, at: str | None = None) -> DataFrame:
    """Seeded continuations of each prompt from the model's first k words: id, sample, words, log_p, score.

    Among candidates of chances p ** (1 / temperature), the largest log chance plus Gumbel noise is a fair draw; the noise
    follows from id, sample, step and word, so reruns and other partitions draw alike. A sample ends where no word is
    allowed and keeps what it has.
    """
    at = at or fresh_dir(prompts.sparkSession, "samples")
    begun = _begun(prompts, id_, text, detector).withColumn("beam_rank", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    states = _written(begun.select(*STATE), f"{at}/step=0")
    every = [states.withColumn("step", F.lit(0))]
    for step in range(1, steps + 1):
        u = lambda w: (F.shiftrightunsigned(F.xxhash64("id", "beam_rank", F.lit(step), w, F.lit(seed)), 11) + 0.5) / F.lit(float(1 << 53))  # noqa: B023, E731
        drawn = _expanded(states, known, detector, None, lambda c: c["log_q"] / temperature - F.log(-F.log(u(c["w"]))), 1)  # noqa: B023
        states = _written(_after(drawn).select(*STATE), f"{at}/step={step}")
        every.append(states.withColumn("step", F.lit(step)))
    out = every[0]
    for more in every[1:]:
        out = out.unionByName(more)
    longest = out.groupBy("id", F.col("beam_rank").alias("sample")).agg(F.max_by(F.struct("words", "log_p", "score"), "step").alias("x"))
    return longest.select(F.col("id").alias(id_), "sample", "x.*")
