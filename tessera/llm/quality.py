"""Quality classifier: supervised subword embeddings.

Each word, each word bigram and each character n-gram (n from 5 to 7, blanks included) is hashed to a
row of an embedding matrix. A document is the average of its rows; a linear layer and softmax give the
chance of label 1. Rows and layer are learned together by stochastic gradient descent in numpy, a
minibatch at a time. As both are linear, a row's product with the layer is computed once, and scoring a
text is the mean of one number for each of its tokens.

Labels are learned from a sample outside the held-out fold whose documents and distinct tokens are both
bounded by parameters; texts are read whole and counted where the rows are. Scoring reads every whole text.

Defined cases: a null or empty text has the mean of nothing, so its score is that of the layer's
offset; documents without a label, or with a null one, are not learned, nor are rows without an id; a
document with both labels counts as 0; of unequal texts under one id that of the least hash is learned;
labels without a document take no place of the sample; very long texts are learned and scored whole;
equal texts have equal scores; repeated rows each give a row; an empty table gives none; with no label,
or one label alone, the score is the share of label 1 (0.5 without any); other columns are kept or
ignored as the caller asks, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, held_out, schema_of, table, text_column, tidy

ROWS = 1 << 16
ORDERS = (5, 6, 7)
MIX = np.uint32(0x9E3779B1)
PAIR = np.uint32(0xC2B2AE3D)


def tokens(text: str, rows: int = ROWS) -> np.ndarray:
    """Row numbers of the words, word bigrams and character n-grams of a text, repeats included."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    if not len(points):
        return np.zeros(0, np.int64)
    points = np.concatenate([[np.uint32(32)], np.where(points <= 32, np.uint32(32), points), [np.uint32(32)]]).astype(np.uint32)
    blank = points == 32
    # Words: a rolling sum of mixed characters by position, from blank to blank.
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    out = []
    if len(starts):
        place = np.arange(len(points), dtype=np.uint32)
        begin = np.zeros(len(points), np.uint32)
        begin[starts] = np.diff(starts, prepend=0)
        place = place - np.cumsum(begin, dtype=np.uint32)
        mixed = (points + np.uint32(1)) * (place * np.uint32(2) + np.uint32(1)) * MIX
        mixed[blank] = 0
        word = np.add.reduceat((mixed ^ (mixed >> np.uint32(13))) * MIX, starts, dtype=np.uint32)
        out.append(word)
        pair = word[:-1] * PAIR + word[1:]
        out.append((pair ^ (pair >> np.uint32(15))) * MIX)
    code = points.copy()
    for n in range(2, ORDERS[-1] + 1):
        if len(points) < n:
            break
        code = code[:-1] * MIX + points[n - 1 :]
        if n in ORDERS:
            out.append((code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA77) + np.uint32(n))
    return (np.concatenate(out) >> np.uint32(32 - rows.bit_length() + 1)) if out else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Model:
    logits: np.ndarray  # of each row, float32
    offset: float

    def score(self, text: str) -> float:
        at = tokens(text, len(self.logits))
        x = self.offset + (float(self.logits[at].mean(dtype=np.float64)) if len(at) else 0.0)
        return 1.0 / (1.0 + np.exp(-min(max(x, -50.0), 50.0)))


def counted(text: str, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a text and the share of its tokens that each has."""
    at, counts = np.unique(tokens(text, rows), return_counts=True)
    return at.astype(np.int32), (counts / max(1, counts.sum())).astype(np.float32)


def packed(doc: tuple[np.ndarray, np.ndarray], rows: int = ROWS) -> tuple[bytes, bytes]:
    """What ``counted`` gives, in few bytes: shares are mostly alike."""
    return doc[0].astype(np.uint16 if rows <= 1 << 16 else np.uint32).tobytes(), zlib.compress(doc[1].tobytes(), 1)


class _Batch:
    """Some documents: the rows that occur in them, and the share of each row (down) in each document (across)."""

    def __init__(self, docs: list[tuple[bytes, bytes]], rows: int):
        at = [np.frombuffer(a, np.uint16 if rows <= 1 << 16 else np.uint32) for a, _ in docs]
        seen = np.zeros(rows, bool)
        for a in at:
            seen[a] = True
        self.rows = np.flatnonzero(seen)
        place = np.zeros(rows, np.int32)
        place[self.rows] = np.arange(len(self.rows))
        self.shares = np.zeros((len(self.rows), len(docs)), np.float32)
        for k, (a, (_, share)) in enumerate(zip(at, docs, strict=True)):
            self.shares[place[a], k] = np.frombuffer(zlib.decompress(share), np.float32)


def fit(texts: list[str], labels: list[int], rows: int = ROWS, **options) -> Model:
    return fit_packed([packed(counted(t, rows), rows) for t in texts], labels, rows, **options)


def fit_packed(docs: list[tuple[bytes, bytes]], labels: list[int], rows: int = ROWS, width: int = 8, epochs: int = 3, least_steps: int = 600, batch: int = 16, rate: float = 4.0, seed: int = 3) -> Model:
    """docs: what ``packed`` gives for each document; they stay packed but for one minibatch. Documents are dealt to minibatches once, and each epoch visits those in an order of its own; a small sample gets as many epochs as make least_steps visits."""
    n, ones = len(labels), sum(labels)
    if not n or ones in (0, n):
        share = min(max((ones / n) if n else 0.5, 1e-3), 1 - 1e-3)
        return Model(np.zeros(rows, np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    table_ = rng.uniform(-1.0 / width, 1.0 / width, (rows, width)).astype(np.float32)
    layer, offset = np.zeros((width, 2), np.float32), np.zeros(2, np.float32)
    dealt = rng.permutation(n)
    dealt = [dealt[low : low + batch] for low in range(0, n, batch)]
    epochs = max(epochs, -(-least_steps // len(dealt)))
    steps = epochs * len(dealt)
    y = np.array(labels)
    for step, number in enumerate(int(i) for _ in range(epochs) for i in rng.permutation(len(dealt))):
        some = dealt[number]
        now = _Batch([docs[i] for i in some], rows)
        hidden = now.shares.T @ table_[now.rows]
        z = hidden @ layer + offset
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(some)), y[some]] -= 1.0
        speed = np.float32(rate * (1 - step / steps))
        back = p @ layer.T
        layer -= speed * np.float32(0.1) * (hidden.T @ p)
        offset -= speed * np.float32(0.01) * p.sum(axis=0)
        table_[now.rows] -= speed * np.float32(10) * (now.shares @ back)
    folded = table_ @ (layer[:, 1] - layer[:, 0])
    return Model(folded.astype(np.float32), float(offset[1] - offset[0]))


def _counted(rows: int):
    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                few = batch.slice(low, 64)
                found = [packed(counted(t, rows), rows) for t in few.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([few.column(0), few.column(1), pa.array([a for a, _ in found], pa.binary()), pa.array([s for _, s in found], pa.binary())], names=["doc_id", "quality", "at", "share"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000, most_entries: int = 16_000_000, rows: int = ROWS, **options) -> Model:
    """Learns from labelled documents outside the held-out fold, in the order of a hash of the id: at most ``sample``, and no more than have ``most_entries`` distinct tokens together (some 3 bytes each in the driver)."""
    known = labels.where(~held_out("doc_id") & F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = known.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most sample rows are sent
    one = whole.groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    found = cut(one.mapInArrow(tidy(_counted(rows)), schema_of(docs, ["doc_id"], "quality int, at binary, share binary")))
    sizes = found.select("doc_id", F.xxhash64("doc_id").alias("h"), (F.octet_length("at") / (2 if rows <= 1 << 16 else 4)).cast("long").alias("n")).orderBy("h", "doc_id").toPandas()  # sample short rows
    few = int((sizes["n"].cumsum() <= most_entries).sum())
    if few < len(sizes):
        last = sizes.iloc[few]
        found = found.where((F.xxhash64("doc_id") < int(last["h"])) | ((F.xxhash64("doc_id") == int(last["h"])) & (F.col("doc_id") < last["doc_id"].item())))
    taken = found.orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    return fit_packed(list(zip(taken["at"], taken["share"], strict=True)), taken["quality"].tolist(), rows, **options)


def scored(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """score as a column of a text."""
    sent = spark.sparkContext.broadcast(model)
    return text_column(lambda texts: [sent.value.score(t or "") for t in texts], T.DoubleType(), 256)


def score(docs: DataFrame, model: Model, kept: list[str], text: str = "text") -> DataFrame:
    """The kept columns with score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                few = batch.slice(low, 256)
                scores = [model.score(t or "") for t in few.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*few.columns[1:], pa.array(scores, pa.float64())], names=[*kept, "score"])

    return docs.select(F.col(text).alias("_text"), *kept).mapInArrow(tidy(run), schema_of(docs, kept, "score double"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
