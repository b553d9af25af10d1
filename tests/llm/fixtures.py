"""Small tables with the cases that every operator must stand."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row string, score string, shard int, slot string, size string, h string, class_id string, _source string, _take int, lang_pred string"


def words(rng: random.Random, n: int, alphabet: str = "abcdefgh") -> str:
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 6))) for _ in range(n))


def odd_documents(spark, seed: int = 1, many: int = 60):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and extra columns whose names clash."""
    rng = random.Random(seed)
    hot = words(rng, 40)
    near = hot.split()
    texts = [words(rng, rng.randint(1, 80)) for _ in range(many)]
    texts += [hot] * 30
    for i in range(8):
        some = list(near)
        some[rng.randrange(0, 3) if i % 2 else -1] = f"x{i}"
        texts.append(" ".join(some))
    texts += ["", " \n\t ", "a", "one two three four", "!!! ???", "\U0001f600 é́ ß İ", words(rng, 30_000), None]
    rows = [(i, t, None if i % 11 == 0 else "en" if i % 2 else "fr", None if i % 13 == 0 else f"s{i % 3 if i % 5 else 0}", None if t is None else len(t), *[None] * 2, 3, "x", None, "y", None, "z", 1, None) for i, t in enumerate(texts)]
    rows += [rows[3]] * 3 + [(None, "no id here at all", None, None, None, *[None] * 10), (None, None, None, None, None, *[None] * 10)] * 2
    return spark.createDataFrame(rows, DOCS)
