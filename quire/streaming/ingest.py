"""Streams: the same operators on files that arrive, and windows over events with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def run_available(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Applies operator to what has arrived since the last run and appends to a Parquet folder.

    Each batch is written under its number, so that a batch repeated after a failure
    replaces what its first try left.
    """

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_files_only(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """The stream (file_id, modified, content, ...) without files of a path and content seen within the delay; state is dropped after it."""
    marked = stream.withColumn("__digest", F.sha2("content", 256)).withWatermark("modified", delay)
    return marked.dropDuplicatesWithinWatermark(["file_id", "__digest"]).drop("__digest")


def windowed_sums(events: DataFrame, at: str = "ts", key: str = "event_type", value: str = "value",
                  length: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """window_start, key, n and total by windows; events later than the delay are left out."""
    window = F.window(at, length, slide or length)
    grouped = events.withWatermark(at, delay).groupBy(window.alias("w"), key)
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")


def sessions(events: DataFrame, at: str = "ts", key: str = "user_id", gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """key, session_start, session_end and n of runs of events without a gap."""
    grouped = events.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("w"), key)
    return grouped.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
