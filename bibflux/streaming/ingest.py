"""Streams: works that arrive as JSON lines, and counts over event time.

Grouping duplicates stays a batch operation, because a new record can join two old groups; streams append canonical records and drop exact
repeats within a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bibflux.functions.text import normalize_title
from bibflux.schema import WORK_DDL
from bibflux.sources.works import map_works


def stream_works(spark: SparkSession, folder: str, per_batch: int = 100) -> DataFrame:
    """Canonical records of the JSON-lines files of a folder, new files as they come."""
    raw = spark.readStream.schema(WORK_DDL).option("maxFilesPerTrigger", per_batch).json(folder)
    return map_works(raw)


def append_records(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there to a parquet folder, each file once, then stops."""
    return records.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)


def for_each_batch(records: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    return records.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_counts(events: DataFrame, time: str = "ts", by: str = "event_type", width: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Rows ``(window_start, by, n)`` of tumbling or sliding windows; events later than ``late`` are dropped from a stream. Works on tables too."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(window.alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def session_counts(events: DataFrame, time: str = "ts", by: str = "user_id", gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Rows ``(by, session_start, session_end, n)`` of sessions that end after ``gap`` without an event."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    counted = rows.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def distinct_records(records: DataFrame, time: str, late: str = "7 days") -> DataFrame:
    """The first record of each normalised title; a stream forgets titles after ``late``."""
    titled = records.withColumn("_title", normalize_title(F.col("title"))).filter("_title <> ''")
    out = titled.withWatermark(time, late).dropDuplicatesWithinWatermark(["_title"]) if records.isStreaming else titled.dropDuplicates(["_title"])
    return out.drop("_title")
