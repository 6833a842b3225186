"""Session operators on streams: event-time sessions with a watermark, per-session counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files that arrive in a folder, one per trigger; event time as a timestamp, as watermarks need it."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def sessions(stream: DataFrame, idle: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Requests of a user in sessions that end after `idle` without one; state of ended sessions goes with the watermark."""
    out = stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", idle).alias("w")).agg(F.count("*").alias("requests"), F.max("value").alias("top"))
    return out.select("user_id", F.col("w.start").alias("first"), F.col("w.end").alias("ends"), "requests", "top")


def class_counts(stream: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events by type and window."""
    out = stream.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("day"), "event_type", "n")
