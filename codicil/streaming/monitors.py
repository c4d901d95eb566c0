"""Structured Streaming jobs (S-03, O-01, O-03, O-04, O-14, O-15, Q-07).

Each function maps a stream to a stream; ``run_available`` drains what is there
into Parquet. Event time must be a ``timestamp``: ``event_time`` casts the
zone-less one. Late rows are dropped after the watermark delay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from codicil.functions.relational import fresh_path


def stream_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S-03. New files under ``path`` as they arrive, schema given."""
    return spark.readStream.schema(schema).parquet(path)


def event_time(stream: DataFrame, column: str = "ts") -> DataFrame:
    return stream.withColumn(column, F.col(column).cast("timestamp"))


def run_available(
    stream: DataFrame, name: str, mode: str = "append", by: list[str] | None = None, path: str | None = None
) -> DataFrame:
    """Process all available input once, exactly once per checkpoint, and read the sink.

    With ``path``, sink and checkpoint stay there, so a later call takes only what
    is new; without, each call starts afresh.
    """
    spark = stream.sparkSession
    path = path or fresh_path(spark, name)
    writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}-checkpoint")
    if by:
        writer = writer.partitionBy(*by)
    query = writer.trigger(availableNow=True).start(path)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def slo_stream(traces: DataFrame, length: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """O-14. Requests and 5xx per closed window, over (ts, status)."""
    return (
        traces.withWatermark("ts", delay)
        .groupBy(F.window("ts", length))
        .agg(F.count("*").alias("requests"), F.count_if(F.col("status") >= 500).alias("errors"))
        .select(F.col("window.start").alias("window_start"), "requests", "errors")
    )


def rate_stream(events: DataFrame, key: str, max_n: int, length: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """O-01. Fixed windows in which a key exceeds its limit."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", length), F.col(key).alias("key"))
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > max_n)
        .select("key", F.col("window.start").alias("window_start"), "n")
    )


def burst_stream(events: DataFrame, threshold: int, length: str = "1 hour", step: str = "15 minutes", delay: str = "10 minutes") -> DataFrame:
    """O-03. Sliding windows per corpus above the threshold."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", length, step), "corpus_id")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > threshold)
        .select("corpus_id", F.col("window.start").alias("window_start"), "n")
    )


def session_stream(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """O-04. Closed sessions per user."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", gap), "user_id")
        .agg(F.count("*").alias("events"))
        .select("user_id", F.col("session_window.start").alias("session_start"), "events")
    )


def dedupe_traces(traces: DataFrame, delay: str = "1 hour") -> DataFrame:
    """O-15. One trace per request id among repeats within the delay."""
    return traces.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["request_id"])


class CacheState(StatefulProcessor):
    """Q-07 as a stream: keeps one instant per key, the last store, and counts hits."""

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getValueState("stored", "us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        stored = self.stored.get()[0] if self.stored.exists() else None
        out = []
        for us, n in sorted((int(u), int(c)) for pdf in rows for u, c in zip(pdf["us"], pdf["requests"], strict=True)):
            miss = stored is None or us >= stored + self.ttl_us
            if miss:
                stored = us
            out.append((key[0], us, n, int(miss)))
        if stored is not None:
            self.stored.update((stored,))
        yield pd.DataFrame(out, columns=["key", "us", "requests", "misses"])

    def close(self) -> None:
        pass


def cache_stream(requests: DataFrame, ttl_hours: int = 24) -> DataFrame:
    """Q-07. Hits and misses as requests arrive, over (key, us, requests) folded upstream.

    Needs the RocksDB state store. A micro-batch should span less than a lifetime
    of log; the batch form (``cache_hits``) has no such need.
    """
    return requests.groupBy("key").transformWithStateInPandas(
        statefulProcessor=CacheState(ttl_hours * 3_600_000_000),
        outputStructType="key string, us bigint, requests bigint, misses bigint",
        outputMode="Append",
        timeMode="None",
    )
