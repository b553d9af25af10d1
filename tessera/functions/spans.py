"""Text kernels that need positions or byte-exact hashes: Arrow functions, one batch at a time.

Offsets count code points. All functions take null as null and give null for it.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from . import patterns as P

SPAN = "array<struct<feature:string,subtype:string,start:int,end:int,text:string,context:string>>"
OPPORTUNITY = "array<struct<feature:string,kind:string,offset:int,initiates:boolean,subtype:string>>"


@cache
def compiled(pattern: str, multiline: bool = True) -> re.Pattern[str]:
    return re.compile(pattern, re.I | re.U | (re.M if multiline else 0))


def fold(text: str) -> str:
    """Case-folded, with the dotless i that IGNORECASE takes for an i."""
    return text.casefold().replace("ı", "i")


def matches(pattern: str, text: str, folded: str, multiline: bool = True) -> list[re.Match[str]]:
    """All matches; a pattern whose literals the text lacks is not run at all."""
    need = P.needles(pattern)
    if need and not any(n in folded for n in need):
        return []
    return list(compiled(pattern, multiline).finditer(text))


def code_line(text: str, offset: int, pipes_and_fences: bool) -> bool:
    """whether an offset lies on a line of code or data. The matcher also rejects fenced blocks and table lines."""
    if pipes_and_fences and text.count("```", 0, offset) % 2:
        return True
    end = text.find("\n", offset)
    line = text[text.rfind("\n", 0, offset) + 1 : len(text) if end < 0 else end]
    marks = "{}[]`|" if pipes_and_fences else "{}[]`"
    return bool(line.strip()) and bool(re.search(P.CODE_WORDS, line) or any(c in line for c in marks) or re.search(P.ASSIGNMENT, line.strip()))


def triads(text: str) -> list[re.Match[str]]:
    """Rules of three outside code and tables."""
    return [m for m in matches(P.RULE_OF_THREE, text, fold(text)) if not code_line(text, m.start(), True)]


def contrasts(text: str) -> list[tuple[str, int, int, str]]:
    """Surface contrasts (name, start, end, text) that don't overlap, the earlier and shorter first."""
    plain = text.translate(str.maketrans("“”‘’—–", "\"\"''--"))
    folded = fold(plain)
    found = sorted((m.start(), m.end(), name, m.group()) for name, p in P.SURFACE_CONTRASTS.items() for m in matches(p, plain, folded))
    out, last = [], -1
    for start, end, name, hit in found:
        if start >= last:
            out.append((name, start, end, hit))
            last = end
    return out


def around(text: str, start: int, end: int, chars: int) -> str:
    return ("..." if start > chars else "") + text[max(0, start - chars) : end + chars] + ("..." if end + chars < len(text) else "")


def hits(text: str, features: frozenset[str] | None = None, chars: int = 120) -> list[tuple]:
    """Hits (feature, subtype, start, end, text, context), by position."""
    return [(f, sub, s, e, text[s:e], around(text, s, e, chars)) for s, e, f, sub in _found_at(text, fold(text), features)]


def _found_at(text: str, folded: str, features: frozenset[str] | None = None) -> list[tuple]:
    """Hits (start, end, feature, subtype) by position."""
    found = []
    for feature, family in P.FAMILIES.items():
        if feature != "punctuation" and (features is None or feature in features):
            found += [(m.start(), m.end(), feature, sub) for sub, p in family.items() for m in matches(p, text, folded)]
    if features is None or "rule_of_three" in features:
        found += [(m.start(), m.end(), "rule_of_three", "approx_triple") for m in triads(text)]
    if features is None or "surface_contrast" in features:
        found += [(s, e, "surface_contrast", name) for name, s, e, _ in contrasts(text)]
    return sorted(found)


def boundaries(text: str) -> list[int]:
    if not text.strip():
        return []
    return sorted({0} | {m.end() for m in re.finditer(P.BOUNDARY, text)} - {len(text)})


def offsets(text: str, kind: str, most_tokens: int | None = None) -> list[int]:
    """Where a feature could start."""
    if kind == "document_start":
        return [0] if text.strip() else []
    if kind == "token_start":
        return [m.start() for m in re.finditer(P.WORD, text)][:most_tokens]
    if kind in ("clause_boundary", "line_or_sentence_start"):
        return boundaries(text)
    if kind == "final_clause_boundary":
        every = boundaries(text)
        return every[bisect_left(every, int(len(text) * 0.6)) :] or every[-1:]
    if kind == "document_or_final_boundary":
        return sorted({0, *offsets(text, "final_clause_boundary")})
    if kind == "rule_of_three_completion":
        at = {m.start("connector") for m in compiled(P.TRIAD_COMPLETION, False).finditer(text)}
        return sorted(x for x in at if x < len(text) and not code_line(text, x, False))
    raise ValueError(f"no such kind of opportunity: {kind}")


def starts(text: str, feature: str, folded: str | None = None) -> dict[int, str]:
    """Where a feature does start, with the subtype."""
    folded = fold(text) if folded is None else folded
    if feature == "stock_openers_closers":
        return {h[0]: h[3] for h in _found_at(text, folded, frozenset({"stock_openers", "stock_closers"}))}
    if feature == "rule_of_three":
        out = {}
        for m in triads(text):
            if links := list(compiled(P.TRIAD_CONNECTOR, False).finditer(m.group())):
                out[m.start() + links[-1].start()] = "approx_triple"
        return out
    if feature.startswith("discovered_"):
        name = feature.removeprefix("discovered_")
        return {m.start(): name for m in compiled(P.DISCOVERED[name], False).finditer(text)}
    if feature.startswith("neutral_"):
        known = P.neutral("common" if feature.startswith("neutral_common") else "controls")
        pool = known if feature.endswith("controls") else {feature: known[feature]}
        prefix = "neutral_common_" if feature.startswith("neutral_common") else "neutral_"
        return {m.start(): name.removeprefix(prefix) for name, p in pool.items() for m in compiled(p, False).finditer(text)}
    return {h[0]: h[3] for h in _found_at(text, folded, frozenset({feature}))}


def opportunities(text: str, features: list[str], most_tokens: int | None = None) -> list[tuple]:
    """(feature, kind, offset, initiates, subtype) by offset and feature."""
    specs, by_kind, out = P.opportunity_specs(), {}, []
    for feature in features:
        if feature in specs:
            kind, found = specs[feature][0], starts(text, feature)
            if kind not in by_kind:
                by_kind[kind] = offsets(text, kind, most_tokens)
            out += [(feature, kind, at, at in found, found.get(at)) for at in by_kind[kind]]
    return sorted(out, key=lambda x: (x[2], x[0]))


def span_function(features: tuple[str, ...] | None = None, chars: int = 120):
    chosen = None if features is None else frozenset(features)

    @F.pandas_udf(SPAN)
    def tier1_hits(texts: pd.Series) -> pd.Series:
        names = ("feature", "subtype", "start", "end", "text", "context")
        return texts.map(lambda t: None if t is None else [dict(zip(names, h, strict=True)) for h in hits(t, chosen, chars)])

    return tier1_hits


def _found(texts: list[str | None], features: list[str], most_tokens: int | None) -> pa.Array:
    """Opportunities of some texts as one Arrow array, column by column."""
    specs = P.opportunity_specs()
    known = sorted(f for f in features if f in specs)
    subtypes: dict[str, int] = {}
    ends, parts = [0], []
    for text in texts:
        by_kind, at, codes = {}, [], []
        folded = fold(text) if text is not None else ""
        for feature in known if text is not None else []:
            kind, found = specs[feature][0], starts(text, feature, folded)
            if kind not in by_kind:
                by_kind[kind] = np.array(offsets(text, kind, most_tokens), np.int32)
            code = np.full(len(by_kind[kind]), -1, np.int32)
            for x, subtype in found.items():
                i = int(np.searchsorted(by_kind[kind], x))
                if i < len(code) and by_kind[kind][i] == x:
                    code[i] = subtypes.setdefault(subtype, len(subtypes))
            at.append(by_kind[kind])
            codes.append(code)
        sizes = [len(x) for x in at]
        if sum(sizes):
            flat = np.concatenate(at)
            order = np.argsort(flat, kind="stable")
            parts.append((flat[order], np.concatenate(codes)[order], np.repeat(np.arange(len(known), dtype=np.int32), sizes)[order]))
        ends.append(ends[-1] + sum(sizes))
    at, code, which = (np.concatenate([np.zeros(0, np.int32), *x]) for x in (zip(*parts, strict=True) if parts else [()] * 3))
    columns = [
        pa.array(known, pa.string()).take(pa.array(which)),
        pa.array([specs[f][0] for f in known], pa.string()).take(pa.array(which)),
        pa.array(at),
        pa.array(code >= 0),
        pa.array(list(subtypes), pa.string()).take(pa.array(code, mask=code < 0)),
    ]
    lists = pa.array(ends, pa.int32(), mask=np.array([*(t is None for t in texts), False]))
    return pa.ListArray.from_arrays(lists, pa.StructArray.from_arrays(columns, ["feature", "kind", "offset", "initiates", "subtype"]))


def opportunity_function(features: tuple[str, ...], most_tokens: int | None = None):
    """X32 as a column. A text gives thousands of opportunities, so 64 texts leave Python at a time."""

    @F.arrow_udf(OPPORTUNITY)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for low in range(0, len(texts), 64):
                yield _found(texts[low : low + 64].to_pylist(), list(features), most_tokens)

    return found


def opportunity_counts(features: tuple[str, ...], most_tokens: int | None = None):
    """X31, X32 counted where they are found: for each feature with an opportunity how many there are and how many initiate."""
    specs = P.opportunity_specs()
    known = sorted(f for f in features if f in specs)

    def one(text):
        if text is None:
            return None
        by_kind, out, folded = {}, [], fold(text)
        for feature in known:
            kind = specs[feature][0]
            if kind not in by_kind:
                by_kind[kind] = offsets(text, kind, most_tokens)
            if by_kind[kind]:
                found = starts(text, feature, folded)
                out.append({"feature": feature, "kind": kind, "opportunities": len(by_kind[kind]), "initiations": sum(x in found for x in by_kind[kind]) if found else 0})
        return out

    @F.pandas_udf("array<struct<feature:string,kind:string,opportunities:bigint,initiations:bigint>>")
    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return counted


def triad_count(text):
    return _counter(lambda t: len(triads(t)))(text)


def contrast_count(text):
    return _counter(lambda t: len(contrasts(t)))(text)


def contrast_matches(text):
    """Name, start and text of each surface contrast, in order."""

    @F.pandas_udf("array<struct<name:string,start:int,match:string>>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"name": name, "start": start, "match": hit} for name, start, _, hit in contrasts(t)])

    return found(text)


def _counter(of):
    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else of(t)).astype("Int64")

    return count


def blake64(*parts: object) -> str:
    """Sixteen hex digits of an 8-byte BLAKE2b of the parts, joined by NUL."""
    return hashlib.blake2b("\0".join(map(str, parts)).encode(), digest_size=8).hexdigest()


def key_function(*fixed: object):
    """The sampling key of an id under a seed, a source and a split."""

    @F.pandas_udf("string")
    def key(ids: pd.Series) -> pd.Series:
        return ids.map(lambda i: None if i is None else blake64(*fixed, i))

    return key


def shingles(text: str, k: int = 5) -> list[str]:
    """Distinct k-word shingles of the case-folded text; the whole text if it has no more words."""
    words = re.findall(P.WORD, " ".join(text.casefold().split()))
    return sorted({" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}) if words else []


def shingle_count(k: int = 5):
    """How many distinct shingles a text has."""
    return _counter(lambda t: len(shingles(t, k)))


def minhash_function(hashes: int = 64, k: int = 5, first: int = 0):
    """For each seed (from ``first`` on) the least BLAKE2b-64 of the shingles, as sixteen hex digits."""

    @F.pandas_udf("array<string>")
    def signature(texts: pd.Series) -> pd.Series:
        begun = [hashlib.blake2b(f"{seed}\0".encode(), digest_size=8) for seed in range(first, hashes)]

        def least(start, encoded: list[bytes]) -> str:
            best = None
            for data in encoded:
                h = start.copy()
                h.update(data)
                digest = h.digest()
                if best is None or digest < best:
                    best = digest
            return best.hex()

        def one(text):
            if text is None:
                return None
            encoded = [s.encode() for s in shingles(text, k)]
            return [least(start, encoded) for start in begun] if encoded else []

        return texts.map(one)

    return signature


def estimated_jaccard(a, b):
    """The share of equal positions of two signatures; 0 if either is empty."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce((x == y).cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), same / F.least(F.size(a), F.size(b))).otherwise(0.0)


def bands(signature, size: int = 4):
    """Numbered bands of a signature; an incomplete one is dropped."""
    n = F.floor(F.size(signature) / F.lit(size)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("band_no"), F.array_join(F.slice(signature, i * size + 1, size), ":").alias("band")))).otherwise(F.array().cast("array<struct<band_no:int,band:string>>"))
