"""Rebuild on change: file events as a stream, one rebuild at a time."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

IGNORED = r"(^|/)(node_modules|\.git|dist|build|coverage|graphloom-cache)(/|$)"


def latest_changes(events: DataFrame) -> DataFrame:
    """(path, mtime, size): the newest event of each path in a batch, without ignored folders."""
    return events.where(~F.col("path").rlike(IGNORED)).groupBy("path").agg(F.max(F.struct("mtime", "size")).alias("last")).select("path", "last.mtime", "last.size")


def watch(events: DataFrame, rebuild: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "300 milliseconds") -> StreamingQuery:
    """Calls `rebuild` with the changes of each micro-batch; batches never overlap, and later events wait for the next.

    `events` streams (path, mtime, size).  Without `every`, all that is there is processed and the query ends.
    """

    def batch(df: DataFrame, number: int) -> None:
        changes = latest_changes(df)
        if not changes.isEmpty():
            rebuild(changes, number)

    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def file_events(spark: SparkSession, folder: str) -> DataFrame:
    """Event files (JSON lines of path, mtime, size) dropped into a folder, as a stream."""
    return spark.readStream.schema("path STRING, mtime DOUBLE, size BIGINT").json(folder)


def upsert(nodes: DataFrame, changes: DataFrame, parsed: DataFrame) -> DataFrame:
    """Nodes with those of changed paths replaced by freshly parsed rows."""
    return nodes.join(changes.select("path"), "path", "left_anti").unionByName(parsed, allowMissingColumns=True)


def user_activity(events: DataFrame, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """(window start, event_type, n, value): event-time windows with a watermark, over a stream or a table of events."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def ignored(path: str) -> bool:
    return bool(re.search(IGNORED, path))
