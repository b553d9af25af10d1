"""Contracts of what needs a model (G-1 to G-9): tables in, tables out.

A provider is any object with the methods of the contract it fills; without one the operators raise.
Everything downstream (rates, factors, intervals, classes) is relational and never imports a model. The
stub gives repeatable numbers from hashes for tests; its numbers are no measurements.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns that each contract takes and adds.
CONTRACTS = {
    "propensity": (("source", "record_id", "role", "text", "feature", "char_offset"), ("prob_mass", "prefix_tokens")),
    "generation": (("source", "record_id", "prompt", "temperature", "top_p", "completion_index"), ("generation", "generated_tokens")),
    "register": (("doc_id", "text"), tuple(f"f_{i:02d}" for i in range(1, 68))),
    "detector": (("doc_id", "text"), ("probability",)),
    "attribution": (("doc_id", "token_index", "token"), ("score",)),
    "activations": (("doc_id", "text"), ("token_index", "activation")),
    "ablation": (("latent", "doc_id"), ("logit_drop",)),
    "search": (("prompt", "objective"), ("candidate", "score")),
    "parts_of_speech": (("doc_id", "text"), ("contrasts",)),
}


class Provider(Protocol):
    def provide(self, kind: str, df: DataFrame) -> DataFrame: ...


class MissingProvider(RuntimeError):
    pass


def _require(what: str, names: Iterable[str], df: DataFrame) -> None:
    if lacking := set(names) - set(df.columns):
        raise ValueError(f"{what} lacks {sorted(lacking)}")


def provided(provider: Provider | None, kind: str, df: DataFrame) -> DataFrame:
    """The provider's table, checked against the contract on both sides."""
    takes, adds = CONTRACTS[kind]
    if provider is None:
        raise MissingProvider(f"no provider of {kind}")
    _require(f"input of {kind}", takes, df)
    out = provider.provide(kind, df)
    _require(f"output of {kind}", adds, out)
    return out


_SCORERS: dict[str, Callable] = {}


def _scorer(token: str, make: Callable) -> Callable:
    """One for each worker process: a model is loaded when its first batch comes."""
    if token not in _SCORERS:
        _SCORERS[token] = make()
    return _SCORERS[token]


def scored_in_batches(df: DataFrame, kind: str, make: Callable, added: str, known: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """The batch form of a contract: rows go to a scorer in Arrow batches and come back with the added columns (given as DDL).

    make: gives the scorer, a function of a record batch that returns one with the added columns, row by row; it is called
    once in each worker. known: rows that were scored before; their keys are not scored again, and they come out with the others.
    """
    takes, adds = CONTRACTS[kind]
    _require(f"input of {kind}", takes, df)
    fields = T.StructType.fromDDL(added).fields
    names, token = [f.name for f in fields], uuid.uuid4().hex
    if lacking := set(adds) - set(names):
        raise ValueError(f"output of {kind} lacks {sorted(lacking)}")

    def run(batches):
        for batch in batches:
            found = _scorer(token, make)(batch)
            if found.num_rows != batch.num_rows:
                raise ValueError(f"the scorer of {kind} gave {found.num_rows} rows for {batch.num_rows}")
            yield pa.RecordBatch.from_arrays([*batch.columns, *[found.column(c) for c in names]], names=[*batch.schema.names, *names])

    fresh = df if known is None else df.join(known.select(*keys), [*keys], "left_anti").select(*df.columns)
    out = fresh.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))
    return out if known is None else known.select(*out.columns).unionByName(out)


class HashProvider:
    """Numbers in [0, 1) from hashes of all input columns."""

    def __init__(self, kinds: Iterable[str] = CONTRACTS):
        self.kinds = set(kinds)

    def provide(self, kind: str, df: DataFrame) -> DataFrame:
        if kind not in self.kinds:
            raise MissingProvider(f"no provider of {kind}")
        for i, c in enumerate(CONTRACTS[kind][1]):
            u = F.shiftrightunsigned(F.xxhash64(*[F.col(x).cast("string") for x in CONTRACTS[kind][0]], F.lit(i)), 11) / F.lit(float(1 << 53))
            df = df.withColumn(c, F.floor(u * 100).cast("int") if c.endswith(("tokens", "index", "contrasts")) else F.concat(F.lit("text "), u.cast("string")) if c in ("generation", "candidate") else u)
        return df


def span_scores(tokens: DataFrame, longest: int = 4) -> DataFrame:
    """G-5: every run of up to so many tokens of a document with the sum of its scores over the root of its length."""
    from pyspark.sql.window import Window

    w, lengths = Window.partitionBy("doc_id").orderBy("token_index"), range(1, longest + 1)
    scores = [(F.sum("score").over(w.rowsBetween(0, n - 1)) / F.sqrt(F.lit(float(n)))).alias(f"_s{n}") for n in lengths]
    texts = [F.array_join(F.collect_list("token").over(w.rowsBetween(0, n - 1)), " ").alias(f"_t{n}") for n in lengths]
    # One pass for all lengths: the tokens move and are sorted once.
    runs = tokens.select("doc_id", F.col("token_index").alias("start"), *scores, *texts, F.count("*").over(w.rowsBetween(0, longest - 1)).cast("int").alias("_c"))
    spans = runs.withColumn("length", F.explode(F.sequence(F.lit(1), F.col("_c"))))
    own = lambda c: F.coalesce(*[F.when(F.col("length") == n, F.col(f"{c}{n}")) for n in lengths])
    return spans.select("doc_id", "start", "length", own("_t").alias("span"), own("_s").alias("score"))
