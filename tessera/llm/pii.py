"""Personal data in texts: patterns propose spans, checksums and number rules confirm them, words nearby move their score.

Every kind has one pattern that scans a whole text once, in time that grows with its length alone: runs are
taken whole (possessive quantifiers), so no run is tried again from each of its characters. Proposals that fail
their validator go: parts of an address over 255, cards that fail Luhn, account numbers that fail mod 97 or have
another length than their country's, numbers that are never given out. Words within a window around a span raise
or lower its score. Spans of the base kinds stay whatever their score; those of the other kinds need a least
score and, but for account numbers, a place that no other span holds.

Positions are code points, ends exclusive. Per kind, spans are leftmost and don't overlap; kinds may overlap.

Defined cases: a null text is an empty one and holds no span; texts may be of any length; repeated rows are
answered each by itself; an empty table gives no rows; other columns are ignored or, where named in ``kept``,
passed on, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import schema_of, table, tidy

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "local_phone")
#: Code points before and after a span in which words count, and what a word adds or takes.
BEFORE, AFTER, STEP = 48, 24, 0.3
#: Least score of spans of other than the base kinds.
LEAST = 0.6

#: Score of a confirmed span before its surroundings are read.
PRIOR = {"email": 0.9, "ip": 0.5, "card": 0.6, "phone": 0.6, "iban": 0.9, "ssn": 0.4, "local_phone": 0.4}
#: Words in four languages that speak for a kind, and words that speak against any.
FOR = {
    "email": {"email", "mail", "contact", "kontakt", "correo", "courriel"},
    "ip": {"ip", "host", "server", "address", "adresse", "dirección"},
    "card": {"card", "credit", "visa", "mastercard", "amex", "karte", "kreditkarte", "tarjeta", "carte"},
    "phone": {"phone", "telephone", "tel", "call", "mobile", "fax", "telefon", "handy", "teléfono", "móvil", "téléphone"},
    "iban": {"iban", "account", "bank", "konto", "cuenta", "compte", "banque", "banco"},
    "ssn": {"ssn", "social", "security"},
}
FOR["local_phone"] = FOR["phone"]
AGAINST = {"version", "isbn", "sku", "order", "commit", "revision", "token", "serial"}
#: Characters of an account number by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GI": 23, "GR": 27, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![0-9A-Za-z])([A-Z]{2})[0-9]{2}(?: ?[0-9A-Z]){11,30}")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_LOCAL = re.compile(r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_WORD = re.compile(r"[^\W\d_]+")
_LUHN = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)

Place = tuple[int, int]


def luhn(digits: str) -> bool:
    """Every second digit from the right doubled, less 9 from 10 on; the sum is a multiple of 10."""
    back = digits[::-1]
    return (sum(map(int, back[::2])) + sum(_LUHN[int(d)] for d in back[1::2])) % 10 == 0


def mod97(account: str) -> bool:
    """The first four characters behind the others, letters as 10 to 35: 1 modulo 97."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _digits(found: str) -> str:
    return "".join(re.findall("[0-9]+", found))


def emails(text: str) -> Iterator[Place]:
    if "@" in text:
        yield from (m.span() for m in _EMAIL.finditer(text) if m.group(1))


def addresses(text: str) -> Iterator[Place]:
    """Four numbers with dots between; longer chains hold one for each four numbers."""
    for m in _DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(short := p.lstrip("0")) <= 3 and int(short or "0") <= 255 for p in four):
                yield at, end
            at = end + 1


def cards(text: str) -> Iterator[Place]:
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := _digits(m.group())) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[Place]:
    if "+" in text:
        yield from (m.span() for m in _PLUS.finditer(text) if 9 <= len(_digits(m.group())) <= 15)


def accounts(text: str) -> Iterator[Place]:
    """Account numbers, in groups or without spaces; a proposal that fails is tried again from its next characters."""
    at = 0
    while m := _IBAN.search(text, at):
        at = m.start() + 2
        wanted, end = IBAN_LENGTH.get(m.group(1), 0), m.start()
        for taken in range(wanted):
            while taken and end < m.end() and text[end] == " ":
                end += 1
            end += 1
        account = text[m.start() : end].replace(" ", "")
        whole = wanted and end <= m.end() and not text[end : end + 1].isalnum()
        if whole and mod97(account):
            yield m.start(), end
            at = end


def insured(text: str) -> Iterator[Place]:
    for m in _SSN.finditer(text):
        area, group, serial = m.groups()
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


def local_phones(text: str) -> Iterator[Place]:
    yield from (m.span() for m in _LOCAL.finditer(text))


FINDERS: dict[str, Callable[[str], Iterator[Place]]] = {"email": emails, "ip": addresses, "card": cards, "phone": phones, "iban": accounts, "ssn": insured, "local_phone": local_phones}


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's prior, moved by words within the window; words that a window's edge cuts count as they stand there."""
    near = text[max(0, start - BEFORE) : start] + " " + text[end : end + AFTER]
    words = set(_WORD.findall(near.lower()))
    return round(min(1.0, max(0.0, PRIOR[kind] + STEP * bool(words & FOR[kind]) - STEP * bool(words & AGAINST))), 3)


def spans(text: str, least: float = LEAST) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) by start, then kind as listed in KINDS."""
    found = [(start, end, kind, score(text, kind, start, end)) for kind in KINDS[:5] for start, end in FINDERS[kind](text)]
    found = [f for f in found if f[2] in BASE or f[3] >= least]
    taken = sorted(f[:2] for f in found)
    for kind in KINDS[5:]:
        i, more = 0, []
        for start, end in FINDERS[kind](text):
            while i < len(taken) and taken[i][1] <= start:
                i += 1
            free = all(a >= end for a, b in taken[i : i + len(KINDS)] if b > start)
            if free and (points := score(text, kind, start, end)) >= least:
                more.append((start, end, kind, points))
        found += more
        taken = sorted(taken + [f[:2] for f in more])
    return sorted(found, key=lambda f: (f[0], KINDS.index(f[2])))


def redact(text: str, found: list[tuple[int, int, str, float]]) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first one, in brackets."""
    out, at = [], 0
    for start, end, kind, _ in found:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def detected(docs: DataFrame, kept: list[str], least: float = LEAST, with_redacted: bool = False, text: str = "text") -> DataFrame:
    """The kept columns, then ``pii``: an array of (kind, start, end, score, base) by start and kind, and ``redacted``, the text without them, if asked for."""
    struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())])

    def run(batches):
        for batch in batches:
            n = len(kept)
            texts = batch.column(n)
            # Every pattern needs a digit or an at sign.
            maybe = set(pc.indices_nonzero(pc.match_substring_regex(texts, "[0-9@]")).to_pylist())
            sizes, flat, clean = [0], [], []
            for i in range(batch.num_rows):
                own = texts[i].as_py() if i in maybe or with_redacted else ""
                found = spans(own, least) if i in maybe else []
                flat += found
                sizes.append(len(flat))
                if with_redacted:
                    clean.append(redact(own, found))
            columns = [[f[2] for f in flat], [f[0] for f in flat], [f[1] for f in flat], [f[3] for f in flat], [f[2] in BASE for f in flat]]
            values = pa.StructArray.from_arrays([pa.array(c, t.type) for c, t in zip(columns, struct, strict=True)], fields=list(struct))
            arrays = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values)] + [pa.array(clean, pa.string())] * with_redacted
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n)] + arrays, names=[f.name for f in batch.schema][:n] + ["pii", "redacted"][: len(arrays)])

    spec = "pii array<struct<kind: string, start: long, end: long, score: double, base: boolean>>" + ", redacted string" * with_redacted
    taken = docs.select(*(F.col(f"`{c}`") for c in kept), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    return taken.mapInArrow(tidy(run), schema_of(docs, kept, spec))


def joined(found: Column) -> Column:
    """kind:start:end of each span, with commas between."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detected(table(spark, sf_dir, "documents"), ["doc_id"])
    base = F.filter("pii", lambda s: s["base"])

    def of(kind: str):
        return lambda k: k == kind

    counts = [F.size(F.filter("pii.kind", of(kind))).cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))
