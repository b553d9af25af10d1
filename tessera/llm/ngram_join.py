"""N-gram Jaccard join by MinHash banding, with verification on full n-gram sets.

1. Equal texts are one class from the start; only different texts are compared. Texts are told apart by two
   64-bit hashes: those that share the first and differ in the second get numbers of their own.
2. Each text gets a MinHash signature of its word n-grams. Bands and rows are chosen for a target
   recall at the threshold; rows are shuffled on band hashes, and bands met once are dropped.
3. Within a band's bucket, signatures tie texts of likely families together: a text joins the leaders
   it is close to, with a margin that keeps every pair at the threshold in one family. A bucket is
   streamed and gives at most one row for each member and leader, never all pairs. Buckets beyond a
   number of members are dealt into parts; the leaders of the parts meet in pairs of blocks.
4. Families are connected components of these ties. Within a family texts are classed by the number of
   their n-grams, and only those of the same or the next class can be linked. Classes are dealt into
   blocks of bounded size; the n-gram hashes of a text move once for each block that it can be linked
   with, and every pair of blocks is verified on full sets by products of incidence matrices. Out come the
   number of links of each text and a spanning forest.
5. Classes are the components of verified links.

Texts are lower-cased, words are runs of letters and digits; a text of fewer words than n has one n-gram
of all its words. N-grams are compared by 64-bit hashes.

Defined cases: a null text is an empty one; texts without a word have no n-grams and are in a class
with their equals alone; texts may be of any length; repeated rows are copies; a null id counts as a value
and stands for a class only if the class has no other; of repeated rows of the id that stands, one is kept,
chosen by a hash of all columns; an empty table gives an empty result; other columns are ignored, or kept
by ``deduplicated``, whatever their names.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import MOST_BROADCAST, cut, looked_up, row_hash, schema_of, table, tidy
from .components import components

BLOCK = 1024  # texts in a block
BLOCK_GRAMS = 1 << 20  # their n-grams, about
MOST_TOGETHER = 50_000  # members of a bucket in one task
HOT = 1000  # copies beyond which a text's rows don't meet
NEAR = 0.15  # distance within which a text needs no leader of its own
NOISE = 0.1  # of a distance estimated from a signature


def banding(threshold: float = 0.8, recall: float = 0.9995, most_hashes: int = 160) -> tuple[int, int]:
    """Bands and rows for each: the most rows (so the fewest chance meetings) whose bands reach the recall at the threshold within the number of hashes."""
    best = None
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= most_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("the recall needs more hashes")
    return best


@cache
def _alphanumeric() -> np.ndarray:
    return np.array([chr(i).isalnum() for i in range(0x110000)])


@cache
def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def ngrams(text: str, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a whole text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    inside = np.zeros(len(points) + 1, bool)
    inside[1:] = _alphanumeric()[points]
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    if not len(starts):
        return np.zeros(0, np.uint64)
    begin = np.zeros(len(points), np.int64)
    begin[starts] = np.diff(starts, prepend=0)
    place = np.arange(len(points)) - np.cumsum(begin)
    factors = _odd(256, 1)
    value = (points.astype(np.uint64) + np.uint64(1)) * factors[place & 255]
    value[~inside[1:]] = 0
    words = _mix(np.add.reduceat(value, starts))
    turns = _odd(n, 2)
    if len(words) < n:
        return _mix((words * turns[: len(words)]).sum(keepdims=True, dtype=np.uint64))
    grams = words[: len(words) - n + 1] * turns[0]
    for j in range(1, n):
        grams = grams + words[j : len(words) - n + 1 + j] * turns[j]
    return np.unique(_mix(grams))


def signature(grams: np.ndarray, hashes: int) -> np.ndarray:
    factors = _odd(hashes, 3)
    least = np.full(hashes, np.iinfo(np.uint64).max)
    for at in range(0, len(grams), 512):
        np.minimum(least, (grams[at : at + 512, None] * factors).min(axis=0), out=least)
    return least


def band_hashes(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    return _mix((least.reshape(bands, rows) * _odd(rows, 4)).sum(axis=1, dtype=np.uint64) + _odd(bands, 5)).view(np.int64)


def _first(text: Column) -> Column:
    return F.xxhash64(text)


def _second(text: Column) -> Column:
    return F.xxhash64(F.lit("second"), text)


class Identity:
    """Numbers for texts by two hashes: the first, but where unequal texts share it."""

    def __init__(self, other: DataFrame | None):
        self.other = other

    def number(self, rows: DataFrame) -> DataFrame:
        """rows with h0 and h1, which h replaces."""
        if self.other is None:
            return rows.withColumnRenamed("h0", "h").drop("h1")
        return looked_up(rows, self.other, ["h0", "h1"], "left").withColumn("h", F.coalesce("_other", "h0")).drop("h0", "h1", "_other")


def distinct_texts(source: DataFrame) -> tuple[DataFrame, Identity]:
    """source: rows (doc_id, h0, h1, ...). Rows (h, text_id, copies), one for each different text, and how to number texts."""
    sums = [F.min("doc_id").alias("text_id"), F.count("*").alias("copies")]
    found = cut(source.groupBy("h0").agg(*sums, F.min("h1").alias("least"), F.max("h1").alias("most")))
    clash = found.where("least <> most").select("h0", "least")
    if clash.isEmpty():
        return found.select(F.col("h0").alias("h"), "text_id", "copies"), Identity(None)
    apart = cut(looked_up(source.select("doc_id", "h0", "h1"), cut(clash), ["h0"]).groupBy("h0", "h1", "least").agg(*sums))
    other = cut(apart.where("h1 <> least").select("h0", "h1", F.xxhash64(F.lit("other"), "h0", "h1").alias("_other")))
    identity = Identity(other)
    return cut(found.where("least = most").select(F.col("h0").alias("h"), "text_id", "copies").unionByName(identity.number(apart).select("h", "text_id", "copies"))), identity


def _signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """docs: rows (h, text). One row (h, bands, sig, n) for each distinct h with n-grams; sig: 8 bits of each hash; n: how many n-grams."""

    def run(batches):
        seen: set[int] = set()  # a task signs copies once
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                few = batch.slice(low, 512)
                at, band, sig, counts = [], [], [], []
                for i, h in enumerate(few.column(0).to_pylist()):
                    if h in seen:
                        continue
                    seen.add(h)
                    grams = ngrams(few.column(1)[i].as_py(), n)
                    if len(grams):
                        least = signature(grams, bands * rows)
                        at.append(i)
                        counts.append(len(grams))
                        band.append(band_hashes(least, bands, rows))
                        sig.append(((least >> np.uint64(40)) & np.uint64(255)).astype(np.uint8).tobytes())
                flat = pa.array(np.concatenate([np.zeros(0, np.int64), *band]))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * bands), flat)
                yield pa.RecordBatch.from_arrays([few.column(0).take(pa.array(at, pa.int64())), lists, pa.array(sig, pa.binary()), pa.array(counts, pa.int64())], names=["h", "bands", "sig", "n"])

    signed = docs.mapInArrow(tidy(run), "h long, bands array<bigint>, sig binary, n long")
    return signed.groupBy("h").agg(*[F.first(c).alias(c) for c in ("bands", "sig", "n")])


class _Forest:
    """Union-find over numbers 0, 1, 2, ..."""

    def __init__(self, n: int = 0):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _ties(link: float):
    """Ties of the members of each part of a bucket, which come sorted by (band, part): rows (a, b). Leaders of a bucket in several parts come out too, as (a, null, band, sig).

    link: the largest distance of two members that must end up tied, directly or through others.
    """
    # Distances obey the triangle inequality: if a is within NEAR of a leader, every member linked to a is within NEAR + link of it.
    close, reach = 1 - NEAR, 1 - NEAR - link - NOISE

    def run(batches):
        now, names, forest, split = None, [], _Forest(), False
        leaders = np.zeros((0, 0), np.uint8)
        out: list[tuple] = []

        def end():
            if split:
                out.extend((h, None, now[0], leaders[k].tobytes()) for k, h in enumerate(names))

        for batch in batches:
            sigs = batch.column("sig")
            for i, (band, part, h, parts) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("band", "part", "h", "parts")], strict=True)):
                sig = np.frombuffer(sigs[i].as_buffer(), np.uint8)
                if (band, part) != now:
                    end()
                    now, names, forest, split = (band, part), [h], _Forest(1), parts > 1
                    leaders = np.empty((4, len(sig)), np.uint8)
                    leaders[0] = sig
                    continue
                like = (leaders[: len(names)] == sig).mean(axis=1)
                at = np.flatnonzero(like >= reach)
                if len(at):
                    best = int(at[like[at].argmax()])
                    out.append((h, names[best], None, None))
                    for j in at.tolist():
                        if forest.join(best, j):
                            out.append((names[best], names[j], None, None))
                if not len(at) or like[best] < close:
                    if len(names) == len(leaders):
                        leaders = np.concatenate([leaders, np.empty_like(leaders)])
                    leaders[len(names)] = sig
                    names.append(h)
                    forest.up.append(len(names) - 1)
                    if len(at):
                        forest.join(best, len(names) - 1)
            if len(out) > 4096:
                yield _tie_rows(out)
                out.clear()
        end()
        yield _tie_rows(out)

    return run


def _tie_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["a", "b", "band", "sig"])


def _tied(members: DataFrame, link: float) -> DataFrame:
    """members: rows (band, part, parts, h, sig)."""
    sorted_ = members.select("band", "part", "parts", "h", "sig").repartition("band", "part").sortWithinPartitions("band", "part", "h")
    return cut(sorted_.mapInArrow(tidy(_ties(link)), "a long, b long, band long, sig binary"))


def family_ties(signed: DataFrame, threshold: float) -> DataFrame:
    """Rows (a, b) that tie together all texts that share a band and could be linked.

    A bucket is counted before its rows meet; one of over MOST_TOGETHER members is dealt into random parts. Members of
    two parts are linked only if their leaders are near, so a second round over the leaders of such buckets ties the parts:
    in one task for a few leaders, else in a task for each two blocks of them.
    """
    banded = signed.select("h", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("c")).where("c > 1")
    parts = F.ceil(F.col("c") / MOST_TOGETHER)
    met = banded.join(shared, "band").select("h", "band", parts.alias("parts"), F.pmod(F.xxhash64("h", "band"), parts).alias("part"))
    first = _tied(met.join(signed.select("h", "sig"), "h"), 1 - threshold)
    ties = first.where("b is not null").select("a", "b")
    leaders = first.where("b is null").select("band", F.col("a").alias("h"), "sig")
    if leaders.isEmpty():
        return ties
    blocks = leaders.groupBy("band").agg(F.ceil(F.when(F.count("*") > MOST_TOGETHER, F.count("*") * 2 / F.lit(MOST_TOGETHER)).otherwise(1)).alias("s"))
    own = F.pmod(F.xxhash64("h", F.lit(6)), F.col("s"))
    dealt = leaders.join(blocks, "band").withColumn("_own", own).withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1)))
    pairs = dealt.select("band", (F.least("_own", "_o") * F.col("s") + F.greatest("_own", "_o")).alias("part"), F.lit(1).cast("long").alias("parts"), "h", "sig")
    return ties.unionByName(_tied(pairs, 1 - threshold + 2 * NEAR).where("b is not null").select("a", "b"))


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each set of the left has in common with each of the right."""
    if len(left) * len(right) <= 16:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left])
    # Only n-grams that two sets may share need a column.
    flat = np.concatenate(left)
    if left is right:
        every, times = np.unique(flat, return_counts=True)
        every = every[times > 1]
    else:
        every = np.intersect1d(flat, np.concatenate(right))
    if not len(every):
        every = flat[:1]
    out = np.zeros((len(left), len(right)), np.float32)
    rows = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    cols = []
    for x in (left, right):
        flat = np.concatenate(x)
        at = np.minimum(np.searchsorted(every, flat), len(every) - 1)
        cols.append((at, every[at] == flat))
    width = 4096
    for low in range(0, len(every), width):
        dense = []
        for x, r, (at, real) in zip((left, right), rows, cols, strict=True):
            pick = real & (at >= low) & (at < low + width)
            m = np.zeros((len(x), min(width, len(every) - low)), np.float32)
            m[r[pick], at[pick] - low] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out.astype(np.int64)


def verify(left: list[tuple[int, int, np.ndarray]], right: list[tuple[int, int, np.ndarray]] | None, threshold: float) -> list[tuple]:
    """left, right: (h, copies, n-grams); right is None for pairs within the left. Rows (a, texts, docs, b): links of a to different texts and to their documents, or an edge (a, b) of a spanning forest."""
    if not left or (right is not None and not right):
        return []
    other = left if right is None else right
    sizes = [np.array([len(s) for _, _, s in x]) for x in (left, other)]
    sets = [s for _, _, s in left]
    common = _shared(sets, sets if right is None else [s for _, _, s in other])
    linked = common >= threshold * (sizes[0][:, None] + sizes[1][None, :] - common) - 1e-9
    if right is None:
        np.fill_diagonal(linked, False)
    copies = [np.array([c for _, c, _ in x]) for x in (left, other)]
    out: list[tuple] = []
    sides = [(left, linked, copies[1])] if right is None else [(left, linked, copies[1]), (other, linked.T, copies[0])]
    for rows, links, weight in sides:
        texts, docs = links.sum(axis=1), links @ weight
        out += [(h, int(t), int(d), None) for (h, _, _), t, d in zip(rows, texts, docs, strict=True) if t]
    names = [h for h, _, _ in left] + ([h for h, _, _ in other] if right is not None else [])
    shift = 0 if right is None else len(left)
    forest = _Forest(len(names))
    for i, j in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
        if forest.join(i, j + shift):
            out.append((names[i], 0, 0, names[j + shift]))
    return out


PAIR = ["family", "ci", "i", "cj", "j"]  # a family's blocks by class and part


def _verified(threshold: float):
    """Verifies each pair of blocks, whose rows come sorted by pair."""

    def run(batches):
        now, left, right, seen, out = None, [], [], set(), []

        def done():
            if now is None:
                return []
            return verify(left, None if now[1:3] == now[3:] else right, threshold)

        for batch in batches:
            for *pair, is_left, h, copies, grams in zip(*[batch.column(c).to_pylist() for c in (*PAIR, "is_left", "h", "copies", "grams")], strict=True):
                if now != pair:
                    out += done()
                    now, left, right, seen = pair, [], [], set()
                if h not in seen:  # a repeated row of the representative
                    seen.add(h)
                    (left if is_left else right).append((h, copies, np.frombuffer(grams, np.uint64)))
            if len(out) > 4096:
                yield _links(out)
                out = []
        yield _links(out + done())

    return run


def _links(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "texts", "docs", "b"])


def _with_grams(rows: DataFrame, n: int) -> DataFrame:
    """rows with a column text, which grams replaces; a task gives a text once."""
    kept = [c for c in rows.columns if c != "text"]

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                few = batch.slice(low, 256)
                at = []
                for i, h in enumerate(few.column("h").to_pylist()):
                    if h not in seen:
                        seen.add(h)
                        at.append(i)
                grams = [ngrams(few.column("text")[i].as_py(), n).tobytes() for i in at]
                some = few.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in kept], pa.array(grams, pa.binary())], names=[*kept, "grams"])

    return rows.mapInArrow(tidy(run), schema_of(rows, kept, "grams binary"))


def _blocks(families: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """families: rows (node, component). Rows (h, family, class, part, parts, parts_before, parts_after): the class by number of n-grams, and the number of blocks of its and the neighbouring classes."""
    width = -math.log(threshold) * 1.001  # more than linked sizes differ by, whatever the rounding
    classed = families.select(F.col("node").alias("h"), F.col("component").alias("family")).join(signed.select("h", "n"), "h").withColumn("class", F.floor(F.log("n") / F.lit(width)))
    parts = F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum("n") / F.lit(BLOCK_GRAMS)))
    sizes = classed.groupBy("family", "class").agg(parts.alias("parts"))
    by_class = Window.partitionBy("family").orderBy("class")
    beside = lambda f, step: F.when(f("class").over(by_class) == F.col("class") + step, f("parts").over(by_class)).otherwise(0)
    sizes = sizes.withColumn("parts_before", beside(F.lag, -1)).withColumn("parts_after", beside(F.lead, 1))
    return classed.join(sizes, ["family", "class"]).select("h", "family", "class", F.pmod(F.xxhash64("h", F.lit(9)), F.col("parts")).alias("part"), "parts", "parts_before", "parts_after")


def _pairs() -> Column:
    """The pairs of blocks that a row takes part in: with its own class, the one before and the one after."""
    c, p, zero = F.col("class"), F.col("part"), F.lit(0).cast("long")
    pair = lambda ci, i, cj, j, left: F.struct(ci.alias("ci"), i.alias("i"), cj.alias("cj"), j.alias("j"), left.alias("is_left"))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(zero, F.col(n) - 1)).otherwise(F.array().cast("array<bigint>"))
    own = F.transform(upto("parts"), lambda q: pair(c, F.least(p, q), c, F.greatest(p, q), p <= q))
    after = F.transform(upto("parts_after"), lambda q: pair(c, p, c + 1, q, F.lit(True)))
    before = F.transform(upto("parts_before"), lambda q: pair(c - 1, q, c, p, F.lit(False)))
    return F.concat(own, after, before)


def _spread_join(rows: DataFrame, known: DataFrame, texts: DataFrame) -> DataFrame:
    """Joins rows with what is known of their text. Texts with very many copies, a million at most and one for each HOT rows, are sent to all executors, so their rows need not meet in one task."""
    most = (texts.agg(F.sum("copies")).first()[0] or 0) // MOST_BROADCAST
    hot = cut(known.where(F.col("copies") > max(HOT, most)))
    if hot.isEmpty():
        return rows.join(known, "h")
    marked = rows.join(F.broadcast(hot.select("h", F.lit(True).alias("_hot"))), "h", "left")
    return marked.where("_hot").drop("_hot").join(F.broadcast(hot), "h").unionByName(marked.where("_hot is null").drop("_hot").join(known, "h"))


def _joined(docs: DataFrame, threshold: float, n: int, recall: float, doc_id: str, text: str) -> tuple[DataFrame, Identity]:
    bands, rows = banding(threshold, recall)
    whole = F.coalesce(F.col(text), F.lit(""))
    raw = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _first(whole).alias("h0"), _second(whole).alias("h1"), whole.alias("text"))
    texts, identity = distinct_texts(raw)
    source = identity.number(raw)
    signed = cut(_signatures(source.select("h", "text"), n, bands, rows))
    families = components(family_ties(signed, threshold))
    dealt = cut(_blocks(families, signed, threshold).join(texts, "h").withColumnRenamed("text_id", "doc_id"))
    held = looked_up(source, dealt, ["h", "doc_id"])
    unnamed = dealt.where("doc_id is null").drop("doc_id")
    if not unnamed.isEmpty():  # texts without any id: one of the rows of each
        held = held.unionByName(looked_up(source.where("doc_id is null"), unnamed, ["h"]))
    pairs = _with_grams(held.drop("doc_id"), n).select("h", "copies", "family", "grams", F.inline(_pairs()))
    met = pairs.repartition(*PAIR).sortWithinPartitions(*PAIR, "h").select(*PAIR, "is_left", "h", "copies", "grams")
    checked = cut(met.mapInArrow(tidy(_verified(threshold)), "a long, texts long, docs long, b long"))
    counted = checked.where("b is null").groupBy(F.col("a").alias("h")).agg(F.sum("texts").alias("text_links"), F.sum("docs").alias("doc_links"))
    classes = components(checked.where("b is not null").select("a", "b")).select(F.col("node").alias("h"), "component")
    least = classes.join(texts, "h").groupBy("component").agg(F.min("text_id").alias("class_id"))
    linked = cut(classes.join(least, "component").join(counted, "h").select("h", "component", "class_id", "text_links", "doc_links"))
    known = texts.join(linked, "h", "left")  # one row for each text
    found = _spread_join(cut(source.select("doc_id", "h")), known, texts).select(
        "doc_id",
        "text_id",
        F.coalesce("class_id", "text_id").alias("class_id"),
        (F.coalesce("doc_links", F.lit(0)) + F.col("copies") - 1).alias("links"),
        F.coalesce("text_links", F.lit(0)).alias("text_links"),
        "copies",
        "h",
        F.coalesce("component", "h").alias("class_key"),
    )
    return found, identity


def join(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9995, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, text_id (the least id with an equal text), class_id (the least id of its class), links (other documents at the threshold or more, copies included), text_links (different texts among them), copies (documents with an equal text), h, the number of the text, and class_key, which tells classes apart and is never null (class_id is where no row of a class has an id)."""
    return _joined(docs, threshold, n, recall, doc_id, text)[0]


def deduplicated(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9995, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, one of each class: that with the least id."""
    joined, identity = _joined(docs, threshold, n, recall, doc_id, text)
    found = cut(joined.groupBy("doc_id", "h", "class_key").agg(F.count("*").alias("times")))
    kept = found.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("kept")).select(F.col("kept.doc_id").alias("_d"), F.col("kept.h").alias("_k"))
    own = found.join(kept, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_k")), "left")
    verdicts = cut(own.select("doc_id", F.col("h").alias("_h"), F.col("_k").isNotNull().alias("_stays"), "times").where("not _stays or times > 1").select(F.col("doc_id").alias("_id"), "_h", "_stays"))
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = identity.number(docs.select(F.struct("*").alias("_row"), row_hash(docs).alias("_hash"), F.col(doc_id).cast("long").alias("_doc"), _first(whole).alias("h0"), _second(whole).alias("h1")))
    few = F.broadcast(verdicts) if verdicts.count() <= MOST_BROADCAST else verdicts
    judged = rows.join(few, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    once = judged.where("_stays is null").select("_row.*")
    repeated = judged.where("_stays").groupBy("_doc", "h").agg(F.min_by("_row", "_hash").alias("_row")).select("_row.*")
    return once.unionByName(repeated)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).drop("h", "class_key")
