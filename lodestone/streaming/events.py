"""Streams: duplicates within a watermark, windowed and session counts, and a queue that is drained and ends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, folder: str, schema, files: str = "*") -> DataFrame:
    """Parquet files of a folder, or of all paths that a glob has, whose names fit, as a stream, with event times that watermarks accept."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).option("pathGlobFilter", files).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(rows: DataFrame, key: str, late: str | None = "1 hour") -> DataFrame:
    """The first row of each key within the watermark; state older than that is dropped, and so are rows that come later.

    Without a watermark (None) no row is late, in whatever order files are read, and state holds each key once: for what is bounded.
    """
    if late is None:
        return rows.dropDuplicates([key])
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def windowed(rows: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    out = rows.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(rows: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    out = rows.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def drained(rows: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Handles all that is there now, batch by batch, then ends; a rerun goes on where this one stopped."""
    query = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
