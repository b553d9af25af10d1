"""Sequence packing: first-fit decreasing with a tournament tree, in randomised groups.

Each text is tokenized whole and ends with an end id. Its ids are cut at multiples of the sequence
length, so all but the last piece of a document fill a sequence of their own. Documents go to random
groups of a few thousand by a hash of their id, and in each group first-fit decreasing finds the first
bin with room by descending a tournament tree of bin capacities. Groups need nothing from each other, so
no task grows with the input, and however the input is split, it is packed alike. Only of ids that occur
more than once, and of rows without one, the group also depends on place in the input, so that they spread.

Defined cases: a null text is an empty one and yields the end id alone; texts may be of any length;
pieces of equal length go by id, start and checksum; repeated rows are packed each by itself; an empty
table gives no pieces; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, cut, schema_of, table, tidy

#: Texts of these characters alone take the word cache; others go through the whole tokenizer.
PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿŒœ]*")
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿœ]+|[0-9]|[^\sa-zß-öø-ÿœ0-9]+")
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_OPEN: dict[str, WordTokenizer] = {}


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it is printable, else the next one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordTokenizer:
    """Ids of whole texts. A tokenizer that splits into lower-case words is asked once for each word it meets; any other, or any text with unusual characters, is run as it is."""

    def __init__(self, path: str, most_words: int = 500_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.most_words = most_words
        self.words: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        norms = (made.get("normalizer") or {}).get("normalizers", [])
        splits = (made.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.by_word = norms == NORMALIZERS and splits[0].get("pattern", {}).get("Regex") == SPLIT and made.get("post_processor") is None
        self.by_word &= made["model"]["type"] == "BPE" and len(splits) == 2 and splits[1] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": splits[1].get("trim_offsets"), "use_regex": False}
        self.model, self.letters = self.whole.model, _byte_letters()
        self.specials = [x["content"] for x in made.get("added_tokens", [])]

    def _encode(self, text: str) -> bytes:
        ids = self.whole.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not self.by_word or not PLAIN.fullmatch(text) or any(x in text for x in self.specials):
            return self._encode(text)
        words, found = WORDS.findall(text.lower()), self.words
        try:
            return b"".join(map(found.__getitem__, words))
        except KeyError:
            pass
        new = [w for w in dict.fromkeys(words) if w not in found]
        if len(found) + len(new) > self.most_words:
            found.clear()
            new = list(dict.fromkeys(words))
        for w in new:
            ids = [t.id for t in self.model.tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(self.letters))]
            found[w] = struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(found.__getitem__, words))


def tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker and file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _OPEN:
        _OPEN[path] = WordTokenizer(path)
    return _OPEN[path]


def first_fit_decreasing(lengths: Iterable[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, which must come in descending order."""
    lengths = list(lengths)
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    room = [capacity] * (2 * leaves)  # room[i]: the most room of any bin below node i
    bins, offsets = [], []
    for n in lengths:
        i = 1
        while i < leaves:
            i *= 2
            if room[i] < n:
                i += 1
        bins.append(i - leaves)
        offsets.append(capacity - room[i])
        room[i] -= n
        while i > 1:
            i //= 2
            a, b = room[2 * i], room[2 * i + 1]
            room[i] = a if a > b else b
    return bins, offsets


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, with_ids: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, salt (a random number), and ids if asked for (little-endian unsigned 32-bit numbers)."""
    end = np.array([end_id], dtype="<u4").tobytes()
    step = 4 * capacity
    fields = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("salt", pa.int64())]

    def pieces_of(batches):
        encode, part = tokenizer(tokenizer_path), TaskContext.get().partitionId()
        row = 0
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                few = batch.slice(low, 512)
                at, out, ids = [], [], []
                for i, t in enumerate(few.column(1).to_pylist()):
                    all_ids = encode(t or "") + end
                    row += 1
                    salt = zlib.crc32(b"%d %d" % (part, row))
                    for start in range(0, len(all_ids), step):
                        piece = all_ids[start : start + step]
                        at.append(i)
                        out.append((start // 4, len(piece) // 4, zlib.crc32(piece), len(all_ids) // 4, salt))
                        if with_ids:
                            ids.append(piece)
                columns = [few.column(0).take(pa.array(at, pa.int64()))] + [pa.array(c, k) for c, (_, k) in zip(zip(*out, strict=True), fields, strict=True)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, names=[doc_id, *[n for n, _ in fields], *["ids"] * with_ids])

    return docs.select(doc_id, text).mapInArrow(tidy(pieces_of), schema_of(docs, [doc_id], "start long, length long, ids_crc32 long, doc_tokens long, salt long" + ", ids binary" * with_ids))


def pack(found: DataFrame, capacity: int = 2048, per_group: int = 4096, doc_id: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to checkpointed pieces."""
    ids = found.where("start = 0").groupBy(doc_id).agg(F.count("*").alias("_n"))
    seen = cut(ids.where("_n > 1").select(F.col(doc_id).alias("_id"), F.col("_n").alias("_again")))
    documents = found.where("start = 0").count()
    groups = max(1, -(-documents // per_group))
    kept = [c for c in found.columns if c != "salt"]

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        base = int(group["_group"].iloc[0]) << 32
        group = group.sort_values(["length", doc_id, "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(group["length"].tolist(), capacity)
        return group[kept].assign(sequence_id=np.array(bins, dtype=np.int64) + base, offset=np.array(offsets, dtype=np.int64))

    few = F.broadcast(seen) if seen.count() <= MOST_BROADCAST else seen
    marked = found.join(few, F.col(doc_id) == F.col("_id"), "left")
    salt = F.when(F.col(doc_id).isNull() | F.col("_again").isNotNull(), F.col("salt")).otherwise(0)
    dealt = marked.withColumn("_group", F.pmod(F.xxhash64(doc_id, salt), F.lit(groups))).select("_group", *kept)
    return dealt.groupBy("_group").applyInPandas(fill, schema_of(found, kept, "sequence_id long, offset long"))


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def packed(docs: DataFrame, tokenizer_path: str | None = None, **options) -> DataFrame:
    return pack(cut(pieces(docs, tokenizer_path or word_bpe(), **options)))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
