"""Streaming views of the call log: windowed spend and leases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    """Files that appear in a folder, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def spend_by_window(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Sum and count of value by event type and window of ``ts``, for events up to ``late`` late. Batch or stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.sum("value").alias("value"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "value", "n")


def open_leases(events: DataFrame, ttl: str = "600 seconds", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user's events that are at most ``ttl`` apart: a lease is renewed by each and expires after the last."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", ttl).alias("s"), "user_id").agg(F.count("*").alias("renewals")).select("user_id", F.col("s.start").alias("opened"), F.col("s.end").alias("expires"), "renewals")
