"""Streams: arriving files, log windows, duplicates and open traces.

All take a streaming DataFrame and work on a batch one too, where Spark allows it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def arriving_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """A row per new file of a folder: path, bytes, modified, hash. Files are read once, oldest first."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("latestFirst", "false").load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("hash"))


def arriving_table(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def counts_by_window(log: DataFrame, time: str, keys: list[str], size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Entries of each key per tumbling or sliding window; rows later than `late` are left out of closed windows."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = log.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("desde"), F.col("w.end").alias("hasta"), *keys, "n")


def sessions(log: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of a key's entries without a gap longer than `gap`."""
    out = log.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("desde"), F.col("w.end").alias("hasta"), "n")


def first_of_each(arrivals: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """Drops repeats of a key; remembers a key for as long as the watermark allows."""
    return arrivals.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def open_traces(log: DataFrame, key: str, time: str, is_end: Column, quiet_ms: int = 3_600_000, late: str = "10 minutes") -> DataFrame:
    """A row per trace when it ends, or has been quiet: entries, first and last moment, and whether it ended."""
    rows = log.select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("at"), is_end.alias("ended")).withWatermark("at", late)

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, first, last, ended = state.get if state.exists else (0, None, None, False)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"key": [keys[0]], "n": [n], "desde_ms": [first], "hasta_ms": [last], "ended": [False]})
            return
        for batch in batches:
            at = batch["at"].astype("datetime64[ms]").astype("int64")
            n += len(batch)
            first = int(at.min()) if first is None else min(first, int(at.min()))
            last = int(at.max()) if last is None else max(last, int(at.max()))
            ended = bool(ended or batch["ended"].any())
        if ended:
            state.remove()
            yield pd.DataFrame({"key": [keys[0]], "n": [n], "desde_ms": [first], "hasta_ms": [last], "ended": [True]})
        else:
            state.update((n, first, last, ended))
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + quiet_ms)

    out = "key string, n long, desde_ms long, hasta_ms long, ended boolean"
    return rows.groupBy("key").applyInPandasWithState(step, out, "n long, first long, last long, ended boolean", "append", GroupStateTimeout.EventTimeTimeout)
