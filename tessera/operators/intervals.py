"""Contrasts found in plain and in tagged text, as blocks of sentences; overlapping blocks become one.

Union of intervals is a running maximum of ends over starts: an interval that begins after it opens a new block.
Intervals are sorted by range into runs; a run gets the maximum and the number of blocks of the runs before it from one row
a run, so a key with a third of all intervals is no single task.

A tagger is a column function from a text to an array of (start, end, tag), code points, end exclusive, in order and
without overlaps; tagged words are replaced by their tags, patterns run over that text, and hits go back to
places in the text. Null and empty texts have no blocks; intervals with a null end or an end before their start
take no part; empty tables give no rows. Columns other than those named play no part.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import patterns as P
from ..functions.spans import fold, matches
from ..storage import cut

SENTENCE_END = re.compile(r"[.!?…]+[\"'”’)\]*_]*(?=\s|$)")
HIT = T.StructType([T.StructField(n, T.StringType() if n == "name" else T.IntegerType()) for n in ("start", "end", "name", "low", "high", "block_start", "block_end")])


def union(df: DataFrame, keys: Sequence[str], low: str, high: str, carried: Sequence[str] = (), least: Sequence[str] = (), most: Sequence[str] = ()) -> DataFrame:
    """keys, low, high and n of each block of intervals that share at least one point (both ends belong to them).

    Carried columns are of the block's first interval, by low, high and then themselves; of others the least and most values are kept.
    """
    rows = df.where(F.col(low) <= F.col(high)).select(*keys, F.col(low).alias("_low"), F.col(high).alias("_high"), *carried, *least, *most)
    first = [F.min(F.struct(*carried)).alias("_first")] if carried else []
    kept = [*first, *[F.min(c).alias(c) for c in least], *[F.max(c).alias(c) for c in most]]
    # Equal intervals are one row; the rest is dealt in runs by key and place, so a key with many intervals has many runs.
    one = rows.groupBy(*keys, "_low", "_high").agg(F.count("*").alias("_n"), *kept)
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")
    placed = cut(one.repartitionByRange(*keys, "_low", "_high").withColumns({"_k": key, "_run": F.spark_partition_id()}))
    run, runs = Window.partitionBy("_k", "_run").orderBy("_low", "_high"), Window.partitionBy("_k").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda df, value, kind: df.groupBy("_k", "_run").agg(kind(value).alias("_v")).select("_k", "_run", kind("_v").over(runs).alias("_before"))
    reach = F.greatest(F.max("_high").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.col("_before"))
    marked = placed.join(before(placed, "_high", F.max), ["_k", "_run"]).withColumn("_opens", F.when(reach.isNull() | (F.col("_low") > reach), 1).otherwise(0)).drop("_before")
    block = F.sum("_opens").over(run.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("_before", F.lit(0))
    numbered = marked.join(before(marked, "_opens", F.sum), ["_k", "_run"]).withColumn("_block", block)
    again = [F.min_by("_first", F.struct("_low", "_high")).alias("_first")] if carried else []
    out = numbered.groupBy(*keys, "_block").agg(F.min("_low").alias(low), F.max("_high").alias(high), F.sum("_n").alias("n"), *again, *[F.min(c).alias(c) for c in least], *[F.max(c).alias(c) for c in most])
    return out.select(*keys, low, high, "n", *[F.col(f"_first.{c}").alias(c) for c in carried], *least, *most)


def _stream(text: str, tags: Sequence[Mapping]) -> tuple[str, list[int], list[tuple[int, int, bool]]]:
    """The tagged text, where its pieces begin, and for each piece its place in the text and whether it is a tag."""
    parts, starts, raw, at, size = [], [], [], 0, 0
    for t in tags:
        for piece, start, end, tag in ((text[at : t["start"]], at, t["start"], False), (t["tag"], t["start"], t["end"], True)):
            if piece:
                parts.append(piece)
                starts.append(size)
                raw.append((start, end, tag))
                size += len(piece)
        at = t["end"]
    if at < len(text):
        parts.append(text[at:])
        starts.append(size)
        raw.append((at, len(text), False))
    return "".join(parts), starts, raw


def _back(starts: list[int], raw: list[tuple[int, int, bool]], start: int, end: int) -> tuple[int, int]:
    i, j = bisect_right(starts, start) - 1, bisect_right(starts, end - 1) - 1
    begin = raw[i][0] if raw[i][2] else raw[i][0] + start - starts[i]
    return begin, raw[j][1] if raw[j][2] else raw[j][0] + end - starts[j]


def _found(text: str, tags: Sequence[Mapping], tagged: Mapping[str, re.Pattern]) -> list[dict]:
    """Hits with the sentences they touch. Patterns of the surface run over the text, others over the tagged one."""
    plain = text.translate(str.maketrans("“”‘’—–", "\"\"''--"))
    spans = [(m.start(), m.end(), name) for name, p in P.SURFACE_CONTRASTS.items() for m in matches(p, plain, fold(plain))]
    if tagged:
        stream, starts, raw = _stream(plain, tags)
        spans += [(*_back(starts, raw, m.start(), m.end()), name) for name, p in tagged.items() for m in p.finditer(stream) if m.end() > m.start()]
    if not spans:
        return []
    ends = [m.end() for m in SENTENCE_END.finditer(plain)]
    out = []
    for start, end, name in sorted(spans):
        low, high = bisect_right(ends, start), bisect_right(ends, end - 1)
        out.append({"start": start, "end": end, "name": name, "low": low, "high": high, "block_start": ends[low - 1] if low else 0, "block_end": ends[high] if high < len(ends) else len(text)})
    return out


def contrast_blocks(docs: DataFrame, key: str, text: str, tagger: Callable[[Column], Column] | None = None, tagged: Mapping[str, str] | None = None) -> DataFrame:
    """key, low and high sentence (from 0), n hits, start, name and match of the first hit, and where the block's sentences begin and end. Texts don't move: hits carry what is cut from them."""
    compiled = {name: re.compile(p, re.I) for name, p in (tagged or {}).items()}

    @F.arrow_udf(T.ArrayType(HIT))
    def found(texts: pa.Array, tags: pa.Array) -> pa.Array:
        return pa.array([_found(t or "", g or [], compiled) for t, g in zip(texts.to_pylist(), tags.to_pylist(), strict=True)], pa.list_(pa.struct([(f.name, pa.string() if f.name == "name" else pa.int32()) for f in HIT])))

    tags = tagger(F.col(text)) if tagger else F.array().cast("array<struct<start: int, end: int, tag: string>>")
    hits = docs.select(F.col(key), F.col(text).alias("_text"), F.explode(found(F.col(text), tags)).alias("h"))
    cut_ = lambda a, b: F.substr("_text", F.col(a) + 1, F.col(b) - F.col(a))
    flat = hits.select(key, "_text", "h.*").select(key, "low", "high", "start", "name", cut_("start", "end").alias("match"), "block_start", "block_end")
    return union(flat, [key], "low", "high", ["start", "name", "match"], ["block_start"], ["block_end"])
