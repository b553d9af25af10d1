"""G-6: a sparse autoencoder with batch top-k: training, codes of all rows, effects of single latents.

Of a batch of N vectors the N * k largest positive activations stay, whichever vectors they belong to. The value that ends
them is found by refined histograms: an activation is a 32-bit float, whose bits sort as its value does; tasks count the upper
16 bits, then, within the bin that holds the end, the lower 16. Activations equal to the last one are told apart by a hash
of item, vector and latent, 16 bits at a time, so exactly N * k stay. Nothing is sorted and no row moves.

Training reads a sample bounded by steps * batch_rows (parameters; whole tables up to that size), written once by batch.
In each step the tasks of a batch add up their gradients; the driver holds the model, two moments of its entries and one gradient a task
(``parts`` of them), so its memory follows from latents and dimensions alone. Decoder vectors have unit length after each step, and the
part of a gradient along them is left out. Latents that no step of a while used learn from what the others leave of a batch.
Codes are for all rows: their N is the number of rows of the table, and counts of bins are summed by a shuffle.

Defined cases: rows whose vector is null, holds null or non-finite entries or has another number of dimensions than most rows
get no codes and a null error, and take no part. Rows of one item and vector get the same codes; where the end falls among such
repeats, they stay or go together, so as many more or fewer than N * k stay as there are repeats of that one. Without a vector to learn from, ValueError; empty tables encode to empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import drop_dir, fresh_dir

_BINS = 1 << 16


@dataclass
class Model:
    """encoder and decoder: one row a latent; codes are relu(x @ encoder.T + encoder_bias)."""

    encoder: np.ndarray
    encoder_bias: np.ndarray
    decoder: np.ndarray
    decoder_bias: np.ndarray

    def dense(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.encoder.T + self.encoder_bias, 0.0).astype(np.float32)

    def parts(self) -> list[np.ndarray]:
        return [self.encoder, self.encoder_bias, self.decoder, self.decoder_bias]


@dataclass(frozen=True)
class Cut:
    """The end of what stays, as 16-bit digits: two of the value, then of the tie hash. No digits: all positive activations stay."""

    digits: tuple[int, ...] = ()

    def digit(self, value: np.ndarray, tie: np.ndarray) -> np.ndarray:
        """The digit after those of the cut."""
        n = len(self.digits)
        return (value >> np.uint32(16 - 16 * n)) & np.uint32(0xFFFF) if n < 2 else (tie >> np.uint64(48 - 16 * (n - 2))) & np.uint64(0xFFFF)

    def sides(self, dense: np.ndarray, ties: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which activations are above the cut, and which share all its digits."""
        value, among = dense.view(np.uint32), (dense > 0) & allowed
        above = np.zeros(dense.shape, bool)
        for i, d in enumerate(self.digits):
            found = Cut(self.digits[:i]).digit(value, ties)
            above |= among & (found > d)
            among &= found == d
        return above, among

    def kept(self, dense: np.ndarray, ties: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        above, among = self.sides(dense, ties, allowed)
        return above | among


def _ties(item: np.ndarray, latents: int) -> np.ndarray:
    """A 64-bit hash for each row and latent; every step mixes all bits, and overflow is meant."""
    z = item.view(np.uint64)[:, None] + np.arange(1, latents + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


#: Rows times latents that a task holds at once.
_CELLS = 1 << 20


def _blocks(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Vectors and item hashes of a few rows at a time, however large the Arrow batches."""
    latents, dims = model.encoder.shape
    step = max(1, _CELLS // latents)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), part.column("h").to_numpy()


def _last_kept(rows: DataFrame, model: Model, keep: int, allowed: np.ndarray, shuffled: bool) -> Cut:
    """The cut that leaves the keep largest of the allowed latents' activations.

    rows: h and x. shuffled: counts are summed before they reach the driver, for tables of any number of tasks.
    """
    cut = Cut()
    while len(cut.digits) < 6:

        def count(batches, cut=cut):
            bins = np.zeros(_BINS, np.int64)
            for x, h in _blocks(batches, model):
                dense = model.dense(x)
                ties = _ties(h, len(allowed))
                _, among = cut.sides(dense, ties, allowed)
                bins += np.bincount(cut.digit(dense.view(np.uint32), ties)[among].astype(np.int64), minlength=_BINS)
            met = np.flatnonzero(bins)
            yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(bins[met])], names=["bin", "n"])

        counts = rows.mapInArrow(count, "bin int, n long")
        found = (counts.groupBy("bin").agg(F.sum("n").alias("n")) if shuffled else counts).toArrow()
        bins = np.zeros(_BINS, np.int64)
        np.add.at(bins, found["bin"].to_numpy(), found["n"].to_numpy())
        from_top = np.cumsum(bins[::-1])[::-1]
        if from_top[0] <= keep:
            return cut  # all that share the digits stay
        at = int(np.flatnonzero(from_top >= keep)[-1])
        cut = Cut((*cut.digits, at))
        if from_top[at] == keep:
            return cut
        keep -= int(from_top[at] - bins[at])
    return cut


def _usable(vector: str, dims: int) -> Column:
    """Whether a vector has that many entries, none null or non-finite; false where it is null."""
    sound = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce((F.size(vector) == dims) & sound, F.lit(False))


def _inputs(vectors: DataFrame, item: str, vector: str, *more: Column) -> DataFrame:
    """Vectors with a hash of item and vector: neither copies of a vector nor rows of one item share it."""
    x = F.col(vector).cast("array<double>")
    return vectors.select(*more, F.xxhash64(F.col(item).cast("string"), x).alias("h"), x.alias("x"))


def dimensions(vectors: DataFrame, vector: str) -> int | None:
    """How many entries most vectors have (of equally many the fewer)."""
    sizes = vectors.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("n")).agg(F.count("*").alias("rows")).where("n > 0")
    first = sizes.orderBy(F.desc("rows"), "n").first()
    return first["n"] if first else None


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-6)


def started(dims: int, latents: int, seed: int = 0) -> Model:
    """Random decoder vectors of unit length, encoders equal to them, no biases."""
    decoder = _unit(np.random.default_rng(seed).uniform(-1.0, 1.0, (latents, dims)))
    return Model(decoder.copy(), np.zeros(latents), decoder, np.zeros(dims))


def gradients(x: np.ndarray, ties: np.ndarray, model: Model, cut: Cut, cells: float, spare: Cut | None, dead: np.ndarray, spare_weight: float) -> tuple[list[np.ndarray], float, np.ndarray]:
    """Gradients in the order of Model.parts(), the squared error, and how often each latent was active.

    The loss is the squared error over cells (entries of the whole batch) and, where spare is given, that of dead latents' reconstruction of
    what is left, times a weight; what is left counts as fixed.
    """
    dense = model.dense(x)
    codes = np.where(cut.kept(dense, ties, np.ones(len(dead), bool)), dense, 0.0).astype(np.float64)
    left = x - codes @ model.decoder - model.decoder_bias
    slopes = -2.0 / cells * left
    back = (slopes @ model.decoder.T) * (codes > 0)
    out = [back.T @ x, back.sum(axis=0), codes.T @ slopes, slopes.sum(axis=0)]
    if spare is not None:
        extra = np.where(spare.kept(dense, ties, dead), dense, 0.0).astype(np.float64)
        slopes = 2.0 * spare_weight / cells * (extra @ model.decoder - left)
        back = (slopes @ model.decoder.T) * (extra > 0)
        out[0] += back.T @ x
        out[1] += back.sum(axis=0)
        out[2] += extra.T @ slopes
    return out, float((left * left).sum()), (codes > 0).sum(axis=0)


def _summed(rows: DataFrame, model: Model, *args) -> tuple[list[np.ndarray], float, np.ndarray]:
    """gradients() over the rows of one batch: one row comes from each of its few tasks."""
    shapes = [p.shape for p in model.parts()]

    def part(batches):
        total = None
        for x, h in _blocks(batches, model):
            slopes, loss, active = gradients(x, _ties(h, shapes[0][0]), model, *args)
            flat = np.concatenate([*[s.ravel() for s in slopes], [loss], active])
            total = flat if total is None else total + flat
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["g"])

    found = rows.mapInArrow(part, "g array<double>").toArrow()["g"]
    total = sum(np.asarray(g.values) for g in found)
    out, at = [], 0
    for s in shapes:
        size = int(np.prod(s))
        out.append(total[at : at + size].reshape(s))
        at += size
    return out, float(total[at]), total[at + 1 :]


def _batches(vectors: DataFrame, item: str, vector: str, dims: int, steps: int, batch_rows: int, parts: int) -> tuple[str, int]:
    """Writes the sample by batch: its folder and the number of batches. Batches are drawn by hash, so rereading them needs no shuffle."""
    sound = _inputs(vectors.where(_usable(vector, dims)), item, vector)
    rows = sound.count()
    batches = max(1, min(steps, rows // batch_rows))
    drawn = F.pmod(F.xxhash64("h", F.lit(1)), F.lit(1 << 30)) < int(min(1.0, batches * batch_rows / max(1, rows)) * (1 << 30))
    # Parts are drawn by the same hash, so copies of a vector under several items share no task.
    dealt = sound.where(drawn if rows > batches * batch_rows else F.lit(True)).select("h", "x", F.pmod(F.xxhash64("h", F.lit(2)), F.lit(batches)).cast("int").alias("batch"), F.pmod(F.xxhash64("h", F.lit(3)), F.lit(parts)).alias("part"))
    at = fresh_dir(vectors.sparkSession, "batches")
    dealt.repartition("batch", "part").drop("part").write.partitionBy("batch").parquet(at)
    return at, batches


def train(vectors: DataFrame, item: str, vector: str, latents: int, k: int, steps: int = 20, batch_rows: int = 4096, parts: int = 8, rate: float = 3e-3, spare_k: int = 0, spare_weight: float = 1 / 32, dead_after: int = 5, seed: int = 0) -> tuple[Model, list[dict]]:
    """The model and for each step its mean squared error, active codes a row and latents without use. Steps of Adam, whose rate falls linearly in the last fifth.

    spare_k: so many codes a row, on average, that latents without use for dead_after steps may spend on what is left; 0: none.
    """
    spark, dims = vectors.sparkSession, dimensions(vectors, vector)
    if dims is None:
        raise ValueError("no vector to learn from")
    at, batches = _batches(vectors, item, vector, dims, steps, batch_rows, parts)
    model, log = started(dims, latents, seed), []
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model.parts()]
    unused, everywhere = np.zeros(latents, int), np.ones(latents, bool)
    folders = spark.read.parquet(at).groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()  # one row a batch
    if not folders:
        raise ValueError("no vector to learn from")
    for step in range(steps):
        batch, n = folders[step % len(folders)]
        rows = spark.read.schema("h long, x array<double>").parquet(f"{at}/batch={batch}")
        cut, dead = _last_kept(rows, model, n * k, everywhere, shuffled=False), unused >= dead_after
        spare = _last_kept(rows, model, n * min(spare_k, int(dead.sum())), dead, shuffled=False) if spare_k and dead.any() else None
        slopes, loss, active = _summed(rows, model, cut, float(n * dims), spare, dead, spare_weight)
        slopes[2] -= (slopes[2] * model.decoder).sum(axis=1, keepdims=True) * model.decoder
        pace = rate * min(1.0, (steps - step) / max(1.0, steps / 5))
        for p, s, (m, v) in zip(model.parts(), slopes, moments, strict=True):
            m += 0.1 * (s - m)
            v += 0.001 * (s * s - v)
            p -= pace * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.999 ** (step + 1))) + 1e-8)
        model.decoder[:] = _unit(model.decoder)
        unused = np.where(active > 0, 0, unused + 1)
        log.append({"step": step, "rows": n, "error": loss / (n * dims), "active": float(active.sum()) / n, "unused": int((unused >= dead_after).sum())})
    drop_dir(spark, at)
    return model, log


def encode(vectors: DataFrame, item: str, vector: str, model: Model, k: int) -> DataFrame:
    """(item, ids, values, error) of each row: its codes by latent and the mean squared error of its reconstruction."""
    latents, dims = model.encoder.shape
    sound = vectors.where(_usable(vector, dims))
    rows = _inputs(sound, item, vector)
    n = rows.count()
    cut = _last_kept(rows, model, n * k, np.ones(latents, bool), shuffled=True) if n else Cut()
    kind = vectors.schema[item].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at = 0
            for x, h in _blocks([batch], model):
                dense = model.dense(x)
                kept = cut.kept(dense, _ties(h, latents), np.ones(latents, bool))
                ends = pa.array(np.append(0, np.cumsum(kept.sum(axis=1))).astype(np.int32))
                codes = np.where(kept, dense, 0.0).astype(np.float64)
                left = x - codes @ model.decoder - model.decoder_bias
                ids, values = pa.array(np.nonzero(kept)[1].astype(np.int32)), pa.array(codes[kept])
                yield pa.RecordBatch.from_arrays([batch.column("item").slice(at, len(x)), pa.ListArray.from_arrays(ends, ids), pa.ListArray.from_arrays(ends, values), pa.array((left * left).mean(axis=1))], names=["item", "ids", "values", "error"])
                at += len(x)

    coded = _inputs(sound, item, vector, F.col(item).alias("item")).mapInArrow(run, f"item {kind}, ids array<int>, values array<double>, error double")
    none = vectors.where(~_usable(vector, dims)).select(F.col(item).alias("item"), F.array().cast("array<int>").alias("ids"), F.array().cast("array<double>").alias("values"), F.lit(None).cast("double").alias("error"))
    return coded.unionByName(none)


def effects(codes: DataFrame, model: Model, direction: np.ndarray) -> DataFrame:
    """(item, latent, value, effect): how much a linear score of the reconstruction falls when a latent is left out, for each of its codes."""
    pull = F.array(*[F.lit(float(p)) for p in model.decoder @ direction])
    long = codes.select("item", F.explode(F.arrays_zip("ids", "values")).alias("c")).select("item", F.col("c.ids").alias("latent"), F.col("c.values").alias("value"))
    return long.withColumn("effect", F.col("value") * F.get(pull, F.col("latent")))


def latent_effects(codes: DataFrame, model: Model, direction: np.ndarray, n: int) -> DataFrame:
    """Of the n latents of most activation: mean effect over all rows, share of rows with a positive one, sum, greatest value and active rows, in order of mean effect, then sum."""
    rows = codes.agg(F.count("*").alias("rows"))
    by = effects(codes, model, direction).groupBy("latent").agg(F.sum("effect").alias("e"), F.count_if(F.col("effect") > 0).alias("p"), F.sum("value").alias("activation_sum"), F.max("value").alias("max_activation"), F.count("*").alias("active_rows"))
    first = by.orderBy(F.desc("activation_sum"), "latent").limit(n).crossJoin(F.broadcast(rows))  # one row
    out = first.select("latent", (F.col("e") / F.col("rows")).alias("mean_effect"), (F.col("p") / F.col("rows")).alias("positive_rate"), "activation_sum", "max_activation", "active_rows")
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_effect"), F.desc("activation_sum"), "latent")))  # n rows
