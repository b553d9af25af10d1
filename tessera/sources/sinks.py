"""Writers (K1 to K6, K9 to K11)."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import redacted


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """K1: one object a line, keys sorted, nulls kept."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, first: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """K2: with a header; some columns first, the others sorted."""
    rest = sorted(set(df.columns) - set(first))
    df.select(*first, *rest).write.mode(mode).csv(path, header=True, escape='"')


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """K3: Parquet, or CSV if the path says so."""
    if path.endswith(".csv"):
        write_csv(df, path, df.columns, mode)
    else:
        df.write.mode(mode).parquet(path)


def write_clustered(df: DataFrame, path: str, keys: Sequence[str], partitions: int, block_bytes: int = 8 << 20, mode: str = "errorifexists") -> None:
    """Zstd Parquet sorted by keys over ranges, in small row groups that a reader can skip."""
    df.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).write.mode(mode).option("compression", "zstd").option("parquet.block.size", block_bytes).parquet(path)


def report(df: DataFrame, summary: dict, most_rows: int = 1000) -> str:
    """K4: a JSON document of a summary and at most so many records of a small frame."""
    return json.dumps({"summary": summary, "records": [r.asDict(recursive=True) for r in df.limit(most_rows).collect()]}, sort_keys=True, default=str)


def markdown(df: DataFrame, most_rows: int = 1000) -> str:
    """K5: a table in Markdown; floats with three decimals."""
    cell = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    rows = df.limit(most_rows).collect()
    head = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows])


def tracked(df: DataFrame, texts: Sequence[str], order: Sequence[str], most_rows: int = 1000) -> DataFrame:
    """K8: what a tracker is shown of a table: its first rows, with text columns replaced by their lengths."""
    return redacted(df.orderBy(*order).limit(most_rows), texts)


def wide_to_long(df: DataFrame, ids: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """One row for each column that is not an id."""
    values = [c for c in df.columns if c not in ids]
    return df.unpivot(list(ids), values, name, value)


def manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Path, size, digest and time of each file below a folder, and the number of lines of text files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    lines = F.when(F.col("path").rlike(r"\.(jsonl|csv|txt|md)$"), F.regexp_count(F.col("content").cast("string"), F.lit("\n")))
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "modificationTime", lines.cast("long").alias("lines"))
