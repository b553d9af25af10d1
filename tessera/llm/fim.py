"""Fill-in-the-middle: texts cut into prefix, middle and suffix and rearranged, a whole Arrow batch at a time.

The kernel works on the UTF-8 bytes of all texts of a batch together. A table gives each byte a class, a
second one says for each pair of neighbouring classes whether a unit begins there (a code point, word or
line); running counts of beginnings, set back at each document, are searched for the cuts of all rows at
once. The three parts of all documents lie one behind the other in the batch's own buffer, so they become
one Arrow array without a copy and are joined to outputs by Arrow. Bytes are counted in stripes: beside the
texts and their outputs a task holds a few MB, however long a text is.

Where a text is cut and which form it takes follows from its id and the seed alone, so reruns and any
partitioning agree. A text of n units is cut at the two numbers h1 % (n + 1) and h2 % (n + 1). Texts that hold
a sentinel stay plain, so every output can be taken apart again (``restored``): no sentinel overlaps itself or
another, so none can arise where two parts meet.

Defined cases: a null text is an empty one and stays plain; texts may be of any length that Spark's strings
have, less 16 bytes; a null id counts as an empty one, and rows of equal ids are cut at equal numbers; an empty
table gives no rows; other columns are ignored or, where named in ``kept``, passed on, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import schema_of, table, tidy

#: Sentinels that begin prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes of text that the kernel counts at a time, and that it joins to outputs at a time.
STRIPE, SLICE = 1 << 20, 16 << 20

#: Classes of bytes: within a code point, other beginnings, white space but line ends, line ends; 4 is the edge of a document.
_INSIDE, _OTHER, _SPACE, _LINE, _EDGE = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x80:0xC0] = _INSIDE
_CLASS[[0x09, 0x0B, 0x0C, 0x0D, 0x20]] = _SPACE
_CLASS[0x0A] = _LINE


def _begins(unit: str) -> np.ndarray:
    """[class before, class] -> whether a unit begins at the byte. Words take the white space after them, lines their line end."""
    table = np.zeros((5, 5), bool)
    if unit == "chars":
        table[:, _OTHER:] = True
    elif unit == "words":
        table[[_SPACE, _LINE], _OTHER] = True
    elif unit == "lines":
        table[_LINE, _OTHER:] = True
    else:
        raise ValueError(f"no such unit: {unit}")
    table[_EDGE] = True
    return table


def _check(sentinels: tuple[str, str, str]) -> None:
    """Outputs can be taken apart only if no end of a sentinel begins another one or itself."""
    if any(a[i:] == b[: len(a) - i] for a in sentinels for b in sentinels for i in range(1, len(a))) or any(a in b for a in sentinels for b in sentinels if a is not b) or "" in sentinels:
        raise ValueError("sentinels must not overlap")


class Units:
    """Beginnings of units in texts that lie one behind the other in one buffer, text i at starts[i] to starts[i + 1]."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, unit: str):
        self.data, self.starts, self.pairs = data, starts, _begins(unit)
        self.filled = np.unique(starts[:-1][np.diff(starts) > 0])
        low, high = int(starts[0]), int(starts[-1])
        self.edges = np.append(np.arange(low, high, STRIPE), high) if high > low else np.array([low], np.int64)
        #: Units that begin before each stripe, and before each text.
        self.before = np.zeros(len(self.edges), np.int64)
        first = np.zeros(len(starts), np.int64)
        for i, (count, _) in enumerate(self._stripes()):
            at, to = np.searchsorted(starts, [self.edges[i], self.edges[i + 1]], "left")
            here = starts[at:to] - self.edges[i]
            first[at:to] = self.before[i] + np.where(here > 0, count[np.maximum(here, 1) - 1], 0)
            self.before[i + 1] = self.before[i] + count[-1]
        first[starts >= self.edges[-1]] = self.before[-1]
        self.first, self.sizes = first[:-1], np.diff(first)

    def _stripes(self):
        """For each stripe the running count of units that begin in it up to each byte, and its place."""
        for low, high in zip(self.edges[:-1].tolist(), self.edges[1:].tolist(), strict=True):
            kind = _CLASS[self.data[low:high]]
            last = np.empty_like(kind)
            last[1:] = kind[:-1]
            last[0] = _CLASS[self.data[low - 1]] if low > self.starts[0] else _EDGE
            at, to = np.searchsorted(self.filled, [low, high], "left")
            last[self.filled[at:to] - low] = _EDGE
            yield np.cumsum(self.pairs[last, kind], dtype=np.int32), low

    def places(self, units: np.ndarray) -> np.ndarray:
        """The byte where each text's unit of this number (from 0) begins; its end, if it has only so many units."""
        wanted = self.first + units + 1
        out = np.where(units < self.sizes, -1, self.starts[1:])
        order = np.flatnonzero(out < 0)
        order = order[np.argsort(wanted[order], kind="stable")]
        sought = wanted[order]
        for i, (count, low) in enumerate(self._stripes()):
            at, to = np.searchsorted(sought, [self.before[i], self.before[i + 1]], "right")
            out[order[at:to]] = low + np.searchsorted(count, sought[at:to] - self.before[i], "left")
        return out


def rearrange(texts: pa.Array, h1: np.ndarray, h2: np.ndarray, form: np.ndarray, unit: str = "chars", sentinels: tuple[str, str, str] = SENTINELS) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Units, units of prefix and of middle, and outputs of texts without nulls. form: 0 plain, 1 psm, 2 spm."""
    texts = pc.cast(texts, pa.large_binary())
    _, offsets, values = texts.buffers()
    starts = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    found = Units(data, starts, unit)
    cuts = np.sort(np.stack([h1 % (found.sizes + 1), h2 % (found.sizes + 1)]), axis=0)
    bounds = np.empty(3 * len(texts) + 1, np.int64)
    bounds[0::3] = starts
    bounds[1::3], bounds[2::3] = found.places(cuts[0]), found.places(cuts[1])
    parts = pa.Array.from_buffers(pa.large_binary(), 3 * len(texts), [None, pa.py_buffer(bounds), values if values is not None else pa.py_buffer(b"")])
    prefix, middle, suffix = (parts.take(pa.array(np.arange(i, 3 * len(texts), 3))) for i in range(3))
    p, s, m, none = (pa.scalar(x.encode(), pa.large_binary()) for x in (*sentinels, ""))
    plain, psm = pa.array(form == 0), pa.array(form == 1)
    moved = pc.binary_join_element_wise(
        pc.if_else(psm, p, s), pc.if_else(psm, prefix, suffix), pc.if_else(psm, s, p), pc.if_else(psm, suffix, prefix), m, middle, none
    )
    return found.sizes, cuts[0], cuts[1] - cuts[0], pc.cast(pc.if_else(plain, texts, moved), pa.string())


def _slices(sizes: np.ndarray):
    """Runs of rows with together up to SLICE bytes, or one row."""
    low, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > low and total + n > SLICE:
            yield low, i
            low, total = i, 0
        total += n
    if low < len(sizes):
        yield low, len(sizes)


def transformed(docs: DataFrame, kept: list[str], percent: int = 90, spm_percent: int = 20, seed: int = 1, unit: str = "chars", sentinels: tuple[str, str, str] = SENTINELS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The kept columns, then n, form (plain, psm or spm), prefix_units and middle_units (null if plain) and output.

    percent of the texts are rearranged, spm_percent of those with the suffix first. Units are chars (code points), words or lines.
    """
    _begins(unit)
    _check(sentinels)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(hashed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    holds = (whole == "") | F.contains(whole, F.lit(sentinels[0])) | F.contains(whole, F.lit(sentinels[1])) | F.contains(whole, F.lit(sentinels[2]))
    form = F.when(holds | (h[2] % 100 >= percent), 0).when(h[3] % 100 < spm_percent, 2).otherwise(1)
    names = pa.array(["plain", "psm", "spm"])

    def run(batches):
        for batch in batches:
            n = len(kept)
            sizes = pc.binary_length(batch.column(n)).to_numpy(zero_copy_only=False)
            for low, high in _slices(sizes):
                few = batch.slice(low, high - low)
                h1, h2, kind = (few.column(n + i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
                units, prefix, middle, output = rearrange(few.column(n), h1, h2, kind, unit, sentinels)
                moved = pa.array(kind > 0)
                null = pa.scalar(None, pa.int64())
                columns = [pa.array(units, pa.int64()), names.take(pa.array(kind)), *(pc.if_else(moved, pa.array(x, pa.int64()), null) for x in (prefix, middle)), output]
                yield pa.RecordBatch.from_arrays([few.column(i) for i in range(n)] + columns, names=[*(f.name for f in few.schema)][:n] + ["n", "form", "prefix_units", "middle_units", "output"])

    taken = docs.select(*(F.col(f"`{c}`") for c in kept), whole.alias("_text"), h[0].alias("_h1"), h[1].alias("_h2"), form.cast("int").alias("_form"))
    return taken.mapInArrow(tidy(run), schema_of(docs, kept, "n long, form string, prefix_units long, middle_units long, output string"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made from."""
    p, s, m = (F.lit(x) for x in sentinels)
    first, second = F.when(form == "psm", p).otherwise(s), F.when(form == "psm", s).otherwise(p)
    at, last = F.instr(output, second), F.instr(output, m)
    one = F.substring(output, F.length(first) + 1, at - F.length(first) - 1)
    two = F.substring(output, at + F.length(second), last - at - F.length(second))
    middle = F.substring(output, last + F.length(m), F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = transformed(table(spark, sf_dir, "documents"), ["doc_id"])
    back = restored(F.col("output"), F.col("form"))
    return moved.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"),
    )


OP13_SQL = """
WITH hashed AS (
    SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), numbers AS (
    SELECT *, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM hashed
), cuts AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers
), parts AS (
    SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1, n - b) AS suffix FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM parts
"""
