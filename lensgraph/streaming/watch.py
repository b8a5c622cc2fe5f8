"""Structured Streaming: the file watcher, rolling latency, and claim timeouts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lensgraph.functions.texts import basename, node_type


def watch(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """New files as a stream: (file_path, modified, content_hash, kind). Deletions need a snapshot's difference."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_replace(basename(F.col("path")), r"\.[^.]+$", "")
    return raw.select(F.col("path").alias("file_path"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("content_hash"), node_type(name).alias("kind"))


def latency(events: DataFrame, at: str = "ts", value: str = "value", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Mean per window, with a watermark for late rows, and the two flags."""
    w = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, width).alias("w")).agg(F.avg(value).alias("latency"), F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), "n", "latency", (F.col("latency") > 200).alias("optimize"), (F.col("latency") < 100).alias("healthy"))


def claims(reports: DataFrame, minutes: int = 10) -> DataFrame:
    """From (file_path, agent, status, ts): each task's present claim; PENDING with one more retry once no report has come
    for `minutes` of event time. One row of state a task, dropped when it is done."""
    out = "file_path string, agent string, status string, retries long"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        agent, retries = state.get if state.exists else (None, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"file_path": [key[0]], "agent": [None], "status": ["PENDING"], "retries": [retries + 1]})
            return
        rows = pd.concat(list(frames)).sort_values("ts")
        last = rows.iloc[-1]
        if last.status in ("COMPLETED", "FAILED"):
            if state.exists:
                state.remove()
        else:
            state.update((str(last.agent), int(retries)))
            due = int(last.ts.timestamp() * 1000) + minutes * 60_000
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"file_path": [key[0]], "agent": [last.agent], "status": [last.status], "retries": [retries]})

    keyed = reports.withWatermark("ts", f"{minutes} minutes").groupBy("file_path")
    return keyed.applyInPandasWithState(step, out, "agent string, retries long", "append", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is, into a table in memory, and stops: for tests and small reports."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
