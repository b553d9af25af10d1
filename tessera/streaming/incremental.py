"""Structured Streaming forms of resuming, pairing and running counters (R1 to R3), and job progress from logs (R4). The batch operators are the reference for their results."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def resume(stream: DataFrame, keys: Sequence[str], path: str, checkpoint: str):
    """Appends each batch's rows whose keys the table at path does not have yet; a batch that is run again adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(list(keys))
        try:
            known = spark.read.parquet(path).select(*keys)
            fresh = fresh.join(known, list(keys), "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pair_halves(stream: DataFrame, keys: Sequence[str], role: str, value: str) -> DataFrame:
    """R2: a pair comes out once both halves are there; of a half that comes again the later counts; then the state is cleared."""
    kinds = ", ".join(f"{k} {stream.schema[k].dataType.simpleString()}" for k in keys)

    def met(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        have = dict(zip(("chosen", "rejected"), state.get if state.exists else (None, None), strict=True))
        out = []
        for pdf in batches:
            for r, v in zip(pdf[role], pdf[value], strict=True):
                have[r] = v
                if have.get("chosen") is not None and have.get("rejected") is not None:
                    out.append([*key, have["chosen"], have["rejected"]])
                    have = {"chosen": None, "rejected": None}
        if any(v is not None for v in have.values()):
            state.update((have["chosen"], have["rejected"]))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[*keys, "chosen", "rejected"])

    return stream.groupBy(*keys).applyInPandasWithState(met, f"{kinds}, chosen string, rejected string", "chosen string, rejected string", "append", GroupStateTimeout.NoTimeout)


def running_counts(stream: DataFrame, time: str, keys: Sequence[str], window: str, late: str) -> DataFrame:
    """Counters by time window, final once the watermark has passed it."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def progress(logs: DataFrame, job: str, time: str, step: str, total: Column) -> DataFrame:
    """State of each job from its log rows: the last step, steps a second between first and last row, and the seconds left at that rate (null while there is none, 0 once complete)."""
    seen = logs.groupBy(job).agg(F.min(step).alias("first_step"), F.max(step).alias("last_step"), (F.unix_seconds(F.max(time).cast("timestamp")) - F.unix_seconds(F.min(time).cast("timestamp"))).alias("seconds"), F.max(total).alias("total"))
    rate = (F.col("last_step") - F.col("first_step")) / F.nullif(F.col("seconds"), F.lit(0))
    left = F.col("total") - F.col("last_step")
    return seen.select(job, "last_step", "total", rate.alias("steps_per_second"), F.when(left <= 0, 0.0).otherwise(left / F.nullif(rate, F.lit(0.0))).alias("seconds_left"), F.when(left <= 0, "complete").when(rate > 0, "running").otherwise("stalled").alias("state"))
