"""Structured Streaming forms: windowed rules, tail sampling with an inactivity timer, and a durable queue of payloads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumenry.operators.rules import Algorithm, aggregate_columns, aggregate_names
from lumenry.operators.sampling import Pipeline, any_of, usable_pipelines
from lumenry.operators.windows import ZERO_MICROS
from lumenry.plans import conditions


def windowed(stream: DataFrame, ts: str, keys: list[str], algorithms: dict[str, Algorithm], value: str, late: str, width_s: int) -> DataFrame:
    """A rule's aggregates over windows (start, end] of event time; rows later than ``late`` are dropped and counted by Spark.

    A microsecond is taken off before Spark's own [start, end) windows, so a time on a boundary ends its window, and the
    windows are counted from the year 1 as those of the batch form are. Windows without a value give no row. Distinct
    counts can't run on a stream unless they are approximate.
    """
    shifted = stream.withColumn("_ts", F.col(ts).cast("timestamp") - F.expr("interval 1 microsecond")).withWatermark("_ts", late)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    columns: dict[str, Column] = {}
    for key, a in algorithms.items():
        if a.method == "count_distinct" and not a.approximate:
            raise ValueError(f"{key}: count_distinct can't run on a stream; an approximate one can")
        for name, c in zip(aggregate_names(key, a), aggregate_columns(key, a, F.col(value).cast("double"), micros, None, F.col(value)), strict=True):
            columns.setdefault(name, c)
    first = -ZERO_MICROS // 1_000_000 % width_s
    grouped = shifted.groupBy(F.window("_ts", f"{width_s} seconds", startTime=f"{first} seconds").alias("_w"), *keys).agg(*columns.values())
    some = any_of([(F.col(f"{key}_count") > 0) & (F.col(key).isNotNull() if a.method == "stdev" else F.lit(True)) for key, a in algorithms.items()])
    return grouped.filter(some).select(F.unix_timestamp("_w.end").alias("window_end"), *(c for c in grouped.columns if c != "_w"))


class _Sampler(StatefulProcessor):
    """Flags of a group's pipelines; each arrival puts the timer off, and the timer decides."""

    def __init__(self, ttl_ms: int, flags: int) -> None:
        self.ttl_ms, self.flags = ttl_ms, flags

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("group", "spans bigint, matched bigint, latest bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        spans, matched, latest = self.state.get() if self.state.exists() else (0, 0, 0)
        for part in rows:
            spans += len(part)
            matched |= int(np.bitwise_or.reduce(part["bits"].to_numpy()))
            latest = max(latest, int(part["ms"].max()))  # a row that comes late doesn't bring the timer forward
        self.state.update((spans, matched, latest))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(latest + self.ttl_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"group_key": pd.Series([], dtype=str), "spans": pd.Series([], dtype="int64"), "matched": pd.Series([], dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        spans, matched, _ = self.state.get()
        self.state.clear()
        yield pd.DataFrame({"group_key": [str(key[0])], "spans": [spans], "matched": [matched]})

    def close(self) -> None:
        pass


def sample_stream(stream: DataFrame, ts: str, key: str, pipelines: list[Pipeline], ttl_s: int, late: str = "0 seconds") -> DataFrame:
    """(group_key, spans, decision) once a group has been quiet for ``ttl_s`` seconds of event time.

    State is a count and a bit for each pipeline, whatever the group's size; it needs the RocksDB state store.
    """
    from lumenry.functions.scalar import fnv1a_mod
    from lumenry.operators.sampling import RATE_STEPS

    chosen = usable_pipelines(pipelines)
    resolve = conditions.wide(stream.schema)
    bits = sum((F.when(p.parsed.matches(resolve) if p.parsed else F.lit(True), 1 << i).otherwise(0).cast("bigint") for i, p in enumerate(chosen)), F.lit(0).cast("bigint"))
    rows = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    rows = rows.select(F.col(key).cast("string").alias("group_key"), "_ts", bits.alias("bits"), F.unix_millis("_ts").alias("ms"))
    done = rows.groupBy("group_key").transformWithStateInPandas(_Sampler(ttl_s * 1000, len(chosen)), "group_key string, spans bigint, matched bigint", "append", "eventTime")
    decision = F.lit("drop")
    for i, p in reversed(list(enumerate(chosen))):
        decision = F.when(F.col("matched").bitwiseAND(F.lit(1 << i)) != 0, p.decision(fnv1a_mod(F.col("group_key"), RATE_STEPS))).otherwise(decision)
    return done.select("group_key", "spans", decision.alias("decision"))


class Queue:
    """A durable first-in-first-out queue of payloads in a folder: Parquet files in, checkpointed offsets out."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def put(self, payloads: DataFrame, column: str = "payload") -> None:
        payloads.select(F.col(column).cast("binary").alias("payload")).write.mode("append").parquet(self.path)

    def get(self, files_per_trigger: int = 100) -> DataFrame:
        """A stream of payloads, each at least once; the checkpoint of its query is the read position."""
        return self.spark.readStream.schema("payload binary").option("maxFilesPerTrigger", files_per_trigger).parquet(self.path)

    def drain(self, handle, checkpoint: str) -> None:
        """Hand every waiting micro-batch to ``handle(batch)``; a batch that raises is read again the next time."""
        self.get().writeStream.foreachBatch(lambda batch, _: handle(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def trim(self, most_bytes: int) -> int:
        """Drop the oldest files until the queue has at most ``most_bytes``; gives the number dropped."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(conf)
        files = sorted(((s.getModificationTime(), s.getLen(), s.getPath()) for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")), key=lambda x: x[0])
        total, dropped = sum(f[1] for f in files), 0
        for _, size, path in files:
            if total <= most_bytes:
                break
            fs.delete(path, False)
            total, dropped = total - size, dropped + 1
        return dropped


__all__ = ["Queue", "any_of", "sample_stream", "windowed"]
