"""Continuous refresh on Structured Streaming.

A file stream does not report edits in place nor deletions, so the watcher is a clock: every trigger runs the
incremental refresh, whose own diff finds what changed.  A change feed, where there is one, is filtered,
debounced by sessions and de-duplicated under a watermark, and drives the same refresh."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.observability import logger
from weftline.plans.service import Service


def note_changes(events: DataFrame) -> DataFrame:
    """Events (path, ts) about notes only."""
    return events.where(F.lower("path").endswith(".org"))


def bursts(events: DataFrame, gap: str = "400 milliseconds", late: str = "1 minute", by: str | None = None) -> DataFrame:
    """One row for each burst of changes: those closer than the gap count as one; ``by`` names a column whose
    values have bursts of their own."""
    group = F.col(by) if by else (F.length("path") >= 0).alias("corpus")  # one group: sessions need a key
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    found = timed.groupBy(group, F.session_window("ts", gap).alias("burst")).agg(F.count("*").alias("changes"))
    return found.select(*([by] if by else []), "burst.start", "burst.end", "changes")


def latest_changes(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """Each (path, ts) once; what comes later than the watermark is dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["path", "ts"])


def newer_than_watermark(events: DataFrame, manifest: DataFrame) -> DataFrame:
    """Changes newer than what the manifest has indexed, the newest one of each path."""
    newest = events.groupBy("path").agg(F.max("mtime").alias("mtime"))
    known = manifest.select("path", "last_indexed_mtime")
    return newest.join(known, "path", "left").where(F.col("last_indexed_mtime").isNull() | (F.col("mtime") > F.col("last_indexed_mtime"))).select("path", "mtime")


def refreshing(refresh: Callable[[], dict], heard: Callable[[dict], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: refreshes if the batch has rows; a failure is logged and the stream lives."""

    def run(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        try:
            result = refresh()
        except Exception:  # noqa: BLE001 the next trigger tries again
            logger().exception("refresh %d failed", number)
            return
        if heard:
            heard(result)

    return run


def watch(spark: SparkSession, service: Service, checkpoint: str, debounce_ms: int = 400, heard: Callable[[dict], None] | None = None) -> StreamingQuery:
    """Refresh now, then on every tick of the clock."""
    service.start()
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = ticks.writeStream.foreachBatch(refreshing(service.refresh, heard)).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=f"{debounce_ms} milliseconds").start()


def watch_feed(events: DataFrame, refresh: Callable[[], dict], checkpoint: str, debounce_ms: int = 400, heard: Callable[[dict], None] | None = None, once: bool = False) -> StreamingQuery:
    """Refresh on the trigger after any change to a note; a burst between triggers is one refresh."""
    writer = note_changes(events).writeStream.foreachBatch(refreshing(refresh, heard)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{debounce_ms} milliseconds")).start()
