"""Structured Streaming forms of the event-time operators over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, directory: str, pattern: str = "events.parquet") -> DataFrame:
    """The events files of a directory as a stream."""
    schema = spark.read.parquet(f"{directory}/{pattern}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{directory}/{pattern}" + "*")


def windowed(events: DataFrame, width: str = "1 hour", lateness: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Events and value by window and type; works on streams and on tables."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", lateness).groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
