"""Language identification with a string kernel.

The kernel of two texts is the number of character n-grams (n from 1 to 3, a blended spectrum) that
occur in both, presence only, divided by the square roots of their own numbers. Landmarks, the
same number for each language, give a Nyström feature map; one-versus-rest kernel ridge regression is
solved in it. Presence kernels are inner products of presence vectors, so landmarks and regression
fold into one matrix of n-gram weights, and a batch of texts is scored by one matrix product.

N-grams are hashed into a fixed number of columns. Training reads a sample of different labelled texts,
whose size for each language and in all is a parameter. Presence vectors are made where the rows are, so
the driver gets 2 KB for each sampled text, however long it is; scoring reads every whole text.

Defined cases: a null text or one without a letter is ``und`` with score 0; labels that are null are
not learned, nor are rows without an id; a text with several labels is learned under each; copies of a
text take one place of the sample; very long texts are learned and scored whole; of equal best scores the
language first by name is taken; without any label every text is ``und``; repeated rows each give a row;
an empty table gives none; other columns are kept or ignored as the caller asks, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut, held_out, looked_up, schema_of, table, text_column, tidy

UNKNOWN = "und"
MARGIN = 8  # the sketch is right within a few hundredths, so too few texts are left by a chance of e**-1000 at 400 texts
ORDERS = (1, 2, 3)
COLUMNS = 1 << 14
STEPS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def characters(text: str) -> np.ndarray:
    """Code points of the text in lower case, each run of other characters than letters as one blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = (points >= 192) & (points != 215) & (points != 247) | (points >= 97) & (points <= 122)
    points = np.where(letter, points, np.uint32(32))
    keep = np.ones(len(points), bool)
    keep[1:] = letter[1:] | letter[:-1]
    return points[keep]


def presence(text: str, columns: int = COLUMNS) -> np.ndarray:
    """Which columns the n-grams of a text fall into."""
    points, out = characters(text), np.zeros(columns, bool)
    code = np.zeros(len(points), np.uint32)
    for n in ORDERS:
        if len(points) < n:
            break
        code = code[: len(points) - n + 1] * STEPS[n - 1] + points[n - 1 :] * STEPS[0]
        mixed = (code ^ (code >> np.uint32(15))) * STEPS[1] + np.uint32(n)
        out[(mixed >> np.uint32(16)) & np.uint32(columns - 1)] = True
    return out


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # columns x languages, float32
    offset: np.ndarray

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language and a score between 0 and 1 for each text."""
        present = np.stack([presence(t, len(self.weights)) for t in texts]).astype(np.float32)
        norm = np.sqrt(np.maximum(present.sum(axis=1), 1.0))[:, None]
        raw = present @ self.weights / norm + self.offset
        best = raw.argmax(axis=1)
        sharp = np.exp(4.0 * (raw - raw.max(axis=1, keepdims=True)).astype(np.float64))
        return best, 1.0 / sharp.sum(axis=1)


def fit(texts: list[str], labels: list[str], columns: int = COLUMNS, **options) -> Model:
    return fit_presence(np.stack([presence(t, columns) for t in texts]) if texts else np.zeros((0, columns), bool), labels, **options)


def fit_presence(present: np.ndarray, labels: list[str], landmarks: int = 64, ridge: float = 1e-2) -> Model:
    """Nyström features at the first texts of each language, then one-versus-rest ridge regression. present: a presence vector for each text."""
    languages, columns = sorted(set(labels)), present.shape[1]
    if not languages:
        return Model([], np.zeros((columns, 0), np.float32), np.zeros(0, np.float32))
    x = present.astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1.0))
    at = [i for name in languages for i in [i for i, y in enumerate(labels) if y == name][:landmarks]]
    marks = x[at]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > max(values.max(), 1.0) * 1e-6
    root = vectors[:, good] / np.sqrt(values[good])  # K_mm^(-1/2) on its range
    features = (x @ marks.T).astype(np.float64) @ root
    y = np.array([[1.0 if a == b else -1.0 for b in languages] for a in labels])
    # Each language counts the same, whatever its number of texts.
    by = np.array([1.0 / labels.count(a) for a in labels])[:, None] * len(labels) / len(languages)
    middle, mean = (by * features).sum(axis=0) / by.sum(), (by * y).sum(axis=0) / by.sum()
    f = features - middle
    solved = np.linalg.solve(f.T @ (by * f) + ridge * len(labels) * np.eye(f.shape[1]), f.T @ (by * (y - mean)))
    return Model(languages, (marks.T.astype(np.float64) @ (root @ solved)).astype(np.float32), (mean - middle @ solved).astype(np.float32))


def _packed(columns: int):
    """Presence vectors as bits."""

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                few = batch.slice(low, 64)
                bits = [np.packbits(presence(t, columns)).tobytes() for t in few.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([few.column(0), few.column(1), pa.array(bits, pa.binary())], names=["lang", "h", "bits"])

    return run


def train(docs: DataFrame, per_language: int = 400, sample: int = 2000, columns: int = COLUMNS, **options) -> Model:
    """Learns from rows outside the held-out fold: at most per_language different texts for each label and sample in all, chosen by a hash of the text."""
    known = docs.where(~held_out("doc_id") & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0))
    hashed = known.select("lang", F.xxhash64("text").alias("h"))
    # The least hashes of each language are wanted. A sketch of how many texts it has tells below which hash some MARGIN times as many lie, so a common language sends no more rows than a rare one.
    counts = hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    share = F.lit(float(MARGIN * per_language)) / F.col("n")
    few = looked_up(hashed, cut(counts), ["lang"]).where((share >= 1.0) | (F.col("h") / F.lit(2.0**64) + 0.5 < share)).select("lang", "h")
    order = Window.partitionBy("lang").orderBy("h")
    lean = few.distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language)
    chosen = lean.orderBy("r", "h", "lang").limit(sample).select("lang", "h")
    # At most sample rows of two short columns are sent; only the chosen texts move.
    texts = known.select("lang", F.xxhash64("text").alias("h"), "text").join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    rows = texts.mapInArrow(tidy(_packed(columns)), "lang string, h long, bits binary").orderBy("h", "lang").toPandas()
    present = np.stack([np.unpackbits(np.frombuffer(b, np.uint8), count=columns) for b in rows["bits"]]).astype(bool) if len(rows) else np.zeros((0, columns), bool)
    return fit_presence(present, rows["lang"].tolist(), **options)


def _judged(model: Model, texts: list) -> tuple[list[str], list[float]]:
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    judged = [i for i, t in enumerate(texts) if model.languages and t and any(map(str.isalpha, t))]
    if judged:
        best, sure = model.scores([texts[i] for i in judged])
        for i, b, s in zip(judged, best, sure, strict=True):
            names[i], scores[i] = model.languages[b], float(s)
    return names, scores


def language(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """lang_pred as a column of a text."""
    sent = spark.sparkContext.broadcast(model)
    return text_column(lambda texts: _judged(sent.value, texts)[0], T.StringType(), 64)


def identify(docs: DataFrame, model: Model, kept: list[str], text: str = "text") -> DataFrame:
    """The kept columns with lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                few = batch.slice(low, 64)
                names, scores = _judged(model, few.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([*few.columns[1:], pa.array(names), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "score"])

    return docs.select(F.col(text).alias("_text"), *kept).mapInArrow(tidy(run), schema_of(docs, kept, "lang_pred string, score double"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs), ["doc_id"])
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
