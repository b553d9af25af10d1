"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..storage import cut, fresh_dir, shared_dir

__all__ = ["cut", "fresh_dir", "shared_dir", "table", "free_name", "held_out", "looked_up", "row_hash", "MOST_BROADCAST", "schema_of", "text_column", "tidy", "unit"]

#: Rows of a few numbers or short texts that may be sent to all executors: some tens of MB.
MOST_BROADCAST = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def looked_up(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Joins with a checkpointed frame of a few short columns: sent to all executors only while its counted rows are few."""
    return big.join(F.broadcast(small) if small.count() <= MOST_BROADCAST else small, on, how)


def tidy(run):
    """Wraps a function over Arrow batches: at its end the worker, which later tasks use again, gives freed memory back."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped


def text_column(found: Callable[[list], list], kind: T.DataType, rows: int) -> Callable[[Column], Column]:
    """A column of ``found`` over a column of texts, so many rows at a time. The texts alone go to the workers, and what is found alone comes back; other columns stay where they are."""

    def work(batches):
        for texts in batches:
            few = [pa.array(found(texts.slice(low, rows).to_pylist()), to_arrow_type(kind)) for low in range(0, max(1, len(texts)), rows)]
            yield pa.chunked_array(few).combine_chunks()

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidy(work)(batches)

    return F.arrow_udf(run, kind)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    name = wanted
    while name.lower() in taken:
        name = f"_{name}"
    return name


def schema_of(df: DataFrame, kept: list[str], spec: str) -> T.StructType:
    """The schema of some of a frame's columns and more given as text, whatever the columns' names."""
    return T.StructType([df.schema[c] for c in kept] + T.StructType.fromDDL(spec).fields)


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row, which tells rows of one id apart. Types that have no hash count as JSON."""

    def plain(kind: T.DataType) -> bool:
        if isinstance(kind, T.ArrayType):
            return plain(kind.elementType)
        if isinstance(kind, T.StructType):
            return all(plain(f.dataType) for f in kind.fields)
        return not isinstance(kind, (T.MapType, T.VariantType))

    columns = [F.col(f"`{f.name}`") if plain(f.dataType) else F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in df.schema.fields]
    # Each value with its place: a hash skips nulls, so (null, 1) and (1, null) would be alike.
    return F.xxhash64(*[x for i, c in enumerate(columns) for x in (F.lit(i), c)])


def held_out(doc_id: Column | str, remainder: int = 2, of: int = 4) -> Column:
    """Whether crc32(doc_id as text) falls in the held-out fold; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % of == remainder, F.lit(False))


def unit(*columns: Column) -> Column:
    """A number in [0, 1) from a hash of the columns: the same in every run and partitioning."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))
