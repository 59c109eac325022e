"""Job event logs: cursor reads, inactivity and rolling windows; each works on batch and streaming DataFrames alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The event table as a stream of its files."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def after(events: DataFrame, cursor: int, seq: str = "event_id") -> DataFrame:
    return events.where(F.col(seq) > cursor)


def sessions(events: DataFrame, gap: str = "30 minutes", by: str = "user_id", late: str = "1 day") -> DataFrame:
    """Runs of activity that a silence of `gap` ends: the inactivity rule of a job log."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap), by).agg(F.count("*").alias("events")).select(by, F.col("session_window.start").alias("began"), F.col("session_window.end").alias("silent_at"), "events")


def daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Extension: tumbling day windows by kind."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("total")).select(F.col("window.start").alias("day"), "event_type", "events", "total")
