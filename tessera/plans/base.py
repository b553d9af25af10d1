"""Registration of queries over whole tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals rows to all cores for a heavy text kernel where the input has fewer splits than there are cores (few row groups); larger inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for heavy text kernels: the columns they read, over all cores."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The test texts have accented letters as their only letters beyond ASCII; as x they are word characters to every regex engine.
PLAIN = "regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g')"
TOKENS = r"len(regexp_extract_all(text, '[\p{L}\p{N}_](?:[\p{L}\p{N}_'']*[\p{L}\p{N}_])?'))"


def sql_count(pattern: str, text: str = "plain") -> str:
    return f"len(regexp_extract_all({text}, {quoted('(?im)' + pattern)}))"
